"""Operators over pages: microdata as a tree, held to another reading of the same page."""

from html.parser import HTMLParser

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelode.operators import extraction, fingerprints, microdata, prune
from pagelode.plans.queries import ORACLES, QUERIES


class Tree(HTMLParser):
    """A page of well-nested elements as (tag, attributes, children and texts)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ("", {}, [])
        self.stack = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        element = (tag, {k: v or "" for k, v in attrs}, [])
        self.stack[-1][2].append(element)
        if tag not in ("img", "meta", "br"):
            self.stack.append(element)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def plain_items(page):
    """(types, properties) of each item that no other has, properties as (name, text or item), by recursion."""

    def text(e):
        return "".join(c if isinstance(c, str) else text(c) for c in e[2])

    def value(e):
        if "itemscope" in e[1]:
            return item(e)
        for name in ("content", {"a": "href", "img": "src", "time": "datetime", "meta": "content"}.get(e[0], "content")):
            if name in e[1]:
                return e[1][name].strip(" \t\n\f\r")
        return text(e).strip(" \t\n\f\r")

    def item(e):
        found = []

        def walk(x):
            for c in x[2]:
                if not isinstance(c, str):
                    found.extend((n, value(c)) for n in dict.fromkeys(c[1].get("itemprop", "").split()))
                    if "itemscope" not in c[1]:
                        walk(c)

        walk(e)
        return (e[1].get("itemtype", "").split(), found)

    out = []

    def tops(e):
        for c in e[2]:
            if not isinstance(c, str):
                if "itemscope" in c[1] and not ("itemprop" in c[1] and c[1]["itemprop"].split() and inside[id(c)]):
                    out.append(item(c))
                tops(c)

    inside = {}

    def mark(e, within):
        for c in e[2]:
            if not isinstance(c, str):
                inside[id(c)] = within
                mark(c, within or "itemscope" in c[1])

    root = Tree(page).root
    mark(root, False)
    tops(root)
    return out


def nested(rows):
    """The same shape from rows of items."""

    def one(r):
        return (r["types"], [(p["name"], p["value"] if p["child"] is None else one(rows[p["child"]])) for p in r["properties"]])

    return [one(r) for r in rows if r["owner"] is None]


_attributes = st.fixed_dictionaries(
    {},
    optional={
        "itemscope": st.just(""), "itemprop": st.sampled_from(["a", "b", "a b", ""]), "itemtype": st.sampled_from(["https://schema.org/Place", "X Y"]),
        "content": st.sampled_from([" c ", "&amp;"]), "href": st.just("/h"), "datetime": st.just("2024-01-01"), "src": st.just("/s"),
    },
)
_texts = st.sampled_from([" t ", "x &amp; y", "&lt;b&gt;", "\n", "é", "<!-- itemscope -->", "<br>"])


def _page(parts):
    if isinstance(parts, str):
        return parts
    tag, attributes, children = parts
    inner = "".join(f' {k}="{v}"' for k, v in attributes.items())
    return f"<{tag}{inner}>" if tag in ("img", "meta") else f"<{tag}{inner}>{''.join(map(_page, children))}</{tag}>"


_pages = st.recursive(_texts, lambda c: st.tuples(st.sampled_from(["div", "span", "a", "time", "b", "img", "meta"]), _attributes, st.lists(c, max_size=4)), max_leaves=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(_pages, max_size=4))
def test_items_equal_a_reading_by_recursion(parts):
    page = "".join(map(_page, parts))
    assert nested(microdata.items_of(page)) == plain_items(page)


def test_items_of_untidy_pages():
    named = lambda page: [(r["owner"], r["types"], [(p["name"], p["value"]) for p in r["properties"]]) for r in microdata.items_of(page)]
    assert named(None) == named("") == named("<p itemprop=a>x</p>") == []
    # Elements that close themselves, end tags without a start, an element that never ends, an unquoted and an upper-case attribute.
    assert named("<ul ITEMSCOPE></b><li itemprop=a>1<li itemprop=a>2</ul><i itemprop=a>3") == [(None, [], [("a", "1"), ("a", "2")])]
    assert named("<table itemscope><tr><td itemprop=a>1<td itemprop=a>2<tr><td itemprop=a>3</table>") == [(None, [], [("a", "1"), ("a", "2"), ("a", "3")])]
    assert named("<div itemscope><p itemprop=a>1<p itemprop=a>2<div itemprop=a>3</div>4") == [(None, [], [("a", "1"), ("a", "2"), ("a", "3")])]
    assert named("<div itemscope><script>'<i itemprop=a>'</script><title itemprop=t>a <b> c</title>") == [(None, [], [("t", "a <b> c")])]
    # References: to an element elsewhere, to none, to one that has an item, and in a circle.
    assert named('<div itemscope itemref="x no"></div><p id=x><b itemprop=a>1</b></p>') == [(None, [], [("a", "1")])]
    circle = '<div itemscope itemprop=a id=x itemref=y></div><div itemscope itemprop=b id=y itemref=x></div>'
    assert [r["owner"] for r in microdata.items_of(circle)] == [None, 0]
    deep = "<div itemscope itemprop=a>" * 3000
    assert len(microdata.items_of(deep)) == 3000


def test_a_property_behind_a_nested_item_is_its_owners(spark):
    page = '<div itemscope itemtype="https://schema.org/JobPosting"><b itemprop="title">T</b><span itemprop="jobLocation" itemscope itemtype="https://schema.org/Place"><i itemprop="name">N</i></span><time itemprop="datePosted" datetime="2024-01-01">x</time></div>'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<p>none</p>")], "k int, html string")
    got = {r["k"]: [(i["type"], dict(i["properties"])) for i in r["m"]] for r in pages.select("k", extraction.microdata(F.col("html")).alias("m")).collect()}
    assert got == {1: [("JobPosting", {"title": "T", "datePosted": "2024-01-01"}), ("Place", {"name": "N"})], 2: [], 3: []}
    rows = sorted(tuple(r) for r in microdata.item_rows(pages, "k").select("k", "item", "owner", "name").collect() if r["owner"] is not None)
    assert rows == [(1, 1, 0, "name")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abAB", min_size=1, max_size=4), min_size=1, max_size=70), st.lists(st.one_of(st.text("abABé", max_size=30), st.integers(0, 9000).map(lambda n: "c" * n + "abab")), max_size=6))
def test_the_automaton_finds_what_is_there(words, texts):
    automaton = fingerprints.Automaton(words)
    data = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    bits = automaton.found(np.frombuffer(b"".join(data), np.uint8), offsets)
    for row, d in zip(bits, data, strict=True):
        want = {i for i, w in enumerate(words) if w.lower().encode() in d.lower()}
        assert {i for i in range(len(words)) if int(row[i // 64]) >> (i % 64) & 1} == want


def test_marks_and_their_order(spark):
    long = "x" * 5000
    rows = [
        (1, "https://a.teamtailor.com/x", "<i>DATA-BREEZY</i>"), (2, "https://a.example", long[:4090] + "data-BREEZY" + long + "SFSF"), (3, "https://a.example", "<b class='q PHW-x'>"),
        (4, "https://a.example", "phw-x and sfsf"), (5, None, None), (6, "https://a.example", "window.sap.sf=1"), (7, "https://a.example", "sapxsf Efai efai"),
    ]
    pages = spark.createDataFrame(rows, "k int, url string, html string")
    got = {r["k"]: (r["fingerprint"], r["fingerprint_kind"], r["fingerprint_confidence"], len(r["marks"])) for r in fingerprints.with_fingerprint(pages).collect()}
    assert got == {
        1: ("teamtailor", "url", 0.9, 2), 2: ("breezy", "html", 0.85, 2), 3: ("phenom", "html", 0.85, 1), 4: (None, None, None, 0), 5: (None, None, None, 0),
        6: ("sap_successfactors", "global", 0.85, 1), 7: ("eightfold", "global", 0.85, 1),
    }
    hints = fingerprints.with_fingerprint(pages).where("k = 2").first()["api_hints"]
    assert hints == ["https://{slug}.breezy.hr/json"]
    seen = {(r["k"], r["provider"], r["pattern"]) for r in fingerprints.evidence(pages, "k").collect()}
    assert (2, "sap_successfactors", "SFSF") in seen and (1, "breezy", "data-breezy") in seen


def test_content_is_found_by_density_and_names():
    story = "".join(f"<p>Paragraph {i} of the story, with a <a href='/x'>link</a> and some more words in it.</p>" for i in range(4))
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Menu entry {i}</a></li>" for i in range(9)) + "</ul>"
    said = "<div class='user-comments'><p>" + "This is what I think about it all. " * 20 + "</p></div>"
    for opened, closed in (("<article>", "</article>"), ("<div class='x'>", "</div>"), ("<table><tr><td>", "</table>"), ("<section><div>", "</div></section>")):
        page = f"<body><div id='top'>{menu}</div>{opened}<h1>Title</h1>{story}{said}<form>Search the site now please</form>{closed}<div>{menu}</div><footer>All rights reserved by us</footer>"
        text, marked, share = prune.content_of(page)
        assert text.splitlines()[0] == "Title" and len(text.splitlines()) == 5, opened
        assert "Menu" not in text and "think" not in text and "rights" not in text and "Search" not in text
        assert marked.splitlines()[0] == "# Title" and "[link](/x)" in marked and 0 < share < 1


def test_content_of_odd_pages(spark):
    assert prune.content_of(None) == prune.content_of("") == prune.content_of("<nav>all of it</nav>") == prune.content_of("<a href=x>only a link</a>") == (None, None, None)
    assert prune.content_of("just text &amp; more")[0] == "just text & more"
    assert prune.content_of("<div>one<br>two<br/>three</div>")[0] == "one two three"
    assert prune.content_of("<div><p>" + "word " * 30 + "<div><p>" * 500 + "deep text here")[0] is not None
    deep = "<div>" * 3000 + "text at the end of it" + "</div>" * 3000
    assert prune.content_of(deep)[0] == "text at the end of it"
    pages = spark.createDataFrame([(1, "<p>text</p>"), (2, None)], "k int, html string")
    got = {r["k"]: r["c"] for r in pages.select("k", prune.content(F.col("html")).alias("c")).collect()}
    assert got[1]["markdown"] == "text" and (got[2] is None or got[2]["text"] is None)


def test_a_local_model_may_read_dense_markdown(spark):
    def model(texts, limit):
        assert texts == ["text of the page"]
        return [('[{"title":"b","url":"https://x/2"}]', False)]

    pages = spark.createDataFrame([(1, "<div class='menu'>menu</div><p>text of the page</p>")], "k int, html string")
    assert extraction.extract(pages.coalesce(1), model, prompt=extraction.dense_markdown).first()["tier"] == 2


def test_models_are_asked_once_however_many_actions_there_are(spark, tmp_path):
    log = str(tmp_path / "asked")

    def model(texts, limit):
        with open(log, "a") as out:
            out.writelines(t + "\n" for t in texts)
        return [('[{"title":"b","url":"https://x/2"}]', False) if "two" in t else ("no", False) for t in texts]

    pages = spark.createDataFrame([(1, "<p>page one</p>"), (2, "<p>page two</p>"), (3, None)], "k int, html string")
    found = extraction.extract(pages.coalesce(1), model, model)
    assert found.count() == 3 and sorted((r["k"], r["tier"]) for r in found.collect()) == [(1, None), (2, 2), (3, None)]
    with open(log) as asked:
        assert sorted(asked.read().split("\n")) == ["", "page one", "page one", "page two"]  # by the local model, then by the hosted one


def test_cut_references_stay_as_the_sql_has_them(spark, tmp_path):
    import duckdb

    body = "<article><h1>R&amp;D &amp</h1><p>Some words of an article, &lt;b&gt; &quot;and&quot; more, &eacute; &amp;lt; &ampx of them.</p></article>"
    spark.createDataFrame([(k, f"<html><body>{body}</body></html>") for k in range(4)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert {tuple(r) for r in QUERIES["pruned_pages"](spark, str(tmp_path)).collect()} == set(con.execute(ORACLES["pruned_pages"]).fetchall())


def test_items_leave_a_few_pages_at_a_time():
    pages = pd.Series(["<div itemscope><b itemprop=a>x</b></div>", None] * 500)
    parts = list(microdata._items(iter([pages, pages.iloc[:0], pages.iloc[:1]])))
    assert max(map(len, parts)) <= microdata.PAGES and sum(map(len, parts)) == 1001
    assert [x for p in parts for x in p][:2] == [microdata.items_of(pages[0]), []]
