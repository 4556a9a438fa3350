"""Rates of hot sources, intervals of listings, boards as a source, and the SQL surface."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from pagelode.functions.text import content_hash
from pagelode.operators import audit, detect, history, listings, model_output, validate
from pagelode.plans import sql_surface
from pagelode.sources import boards

START = dt.datetime(2024, 1, 1)


def test_split_rates_equal_the_plain_ones(spark):
    rng = random.Random(2)
    rows = [
        (i, rng.choice(["a", "a", "a", "b", None]), rng.choice(["m", None]), START + dt.timedelta(seconds=rng.choice([0, 3600, 86_400, rng.randrange(4 * 86_400)]), milliseconds=rng.choice([0, 700])), rng.choice(["salvaged", "clean", None]))
        for i in range(300)
    ]
    rows += [(1000 + k, "a", "m", START + dt.timedelta(seconds=s), "salvaged") for k, s in enumerate((5, 86_404, 86_405, 86_406, 172_805))]
    events = spark.createDataFrame(rows, "event_id long, source string, model string, ts timestamp, status string")
    shape = lambda df: sorted((r["event_id"], r["n"], round(r["rate"], 9)) for r in df.collect())
    assert shape(audit.salvage_rates_split(events)) == shape(audit.salvage_rates(events))
    assert shape(audit.salvage_rates_split(events, 2)) == shape(audit.salvage_rates(events, 2))
    assert audit.salvage_rates_split(events).columns == audit.salvage_rates(events).columns
    assert audit.salvage_rates_split(events.where("false")).count() == 0


def test_no_window_of_split_rates_holds_a_whole_source(spark):
    """One source alone: its hours are dealt by hour, so windows of more rows than hours are partitioned by them."""
    events = spark.range(5000).select(F.lit("s").alias("source"), F.lit("m").alias("model"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("clean").alias("status"))
    plan = audit.salvage_rates_split(events)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "_t" in line]
    assert windows and all("_h" in line.split("], [")[1] for line in windows)


def plain_intervals(rows):
    times = {}
    for board, _, at in rows:
        times.setdefault(board, set()).add(at)
    out = []
    for board, listing in {(b, x) for b, x, _ in rows}:
        order = sorted(times[board])
        here = {at for b, x, at in rows if (b, x) == (board, listing)}
        runs, closed = [], None
        for k, at in enumerate(order):
            if at in here and (k == 0 or order[k - 1] not in here):
                runs.append([at, at, None, 0, None if closed is None else int((at - closed).total_seconds())])
            if at in here:
                closed = order[k + 1] if k + 1 < len(order) else None
                runs[-1][1:4] = [at, closed, runs[-1][3] + 1]
        out += [(board, listing, n + 1, *r) for n, r in enumerate(runs)]
    return sorted(out, key=str)


def test_intervals_equal_a_plain_walk(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["x", "y", None]), rng.choice(["1", "2", "3", None]), START + dt.timedelta(days=rng.randrange(25))) for _ in range(90)]
    rows += [*rows[:5], ("z", "1", START)]
    found = history.intervals(spark.createDataFrame([*rows, ("x", "1", None)], "board string, listing string, at timestamp"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_intervals(rows)
    last = max(at for _, _, at in rows)
    assert {(r["board"], r["listing"]) for r in history.open_at(found, F.lit(last)).collect()} >= {(b, x) for b, x, at in rows if at == last}


PAGES = {("p", "a"): 7, ("p", "b"): 3, ("q", "c"): 0, ("q", "d"): 6}


def transport():
    """Boards with pages of three; made here, so that it goes to the readers by value."""
    held = dict(PAGES)

    def page(provider, board, offset):
        n = held.get((provider, board))
        return None if n is None else json.dumps({"total": n, "jobs": [{"id": i} for i in range(offset, min(n, offset + 3))]})

    return page


def test_boards_are_a_source_with_filters(spark):
    boards.register(spark, transport(), [*PAGES, ("q", "gone"), ("p", "a")], 3)
    every = spark.read.format("boards").load()
    assert sorted((r["provider"], r["board"], r["offset"], len(json.loads(r["page"])["jobs"])) for r in every.collect()) == [("p", "a", 0, 3), ("p", "a", 3, 3), ("p", "a", 6, 1), ("p", "b", 0, 3), ("q", "d", 0, 3), ("q", "d", 3, 3)]
    some = every.where("provider = 'p' AND board IN ('a', 'zz') AND offset > 0")
    assert sorted(r["offset"] for r in some.collect()) == [3, 6] and some.rdd.getNumPartitions() == 1
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "EqualTo(provider,p)" in plan and "In(board, [a,zz])" in plan
    assert every.where("provider = 'none'").count() == 0
    assert boards.listed("no") == boards.listed("3") == boards.listed("{}") == 0 and boards.listed("[1,2]") == 2


def test_boards_are_a_stream(spark, tmp_path):
    boards.register(spark, transport(), PAGES, 3, "board_stream")

    def run():
        query = spark.readStream.format("board_stream").load().writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["board"], r["offset"]) for r in spark.read.parquet(f"{tmp_path}/o").collect())

    full = [("a", 0), ("a", 3), ("b", 0), ("d", 0), ("d", 3)]
    assert run() == full
    assert run() == full  # started again: nothing new, nothing twice


def test_sql_functions_equal_their_expressions(spark, data):
    put = sql_surface.register(spark, data)
    assert {"content_hash", "provider_of_page", "salvage_rates", "microdata"} <= set(put)
    rows = spark.createDataFrame([(1, "https://jobs.lever.co/x", " <p>a  b</p> it's workday"), (2, "https://x.example/careers", "id='greenhouse"), (3, None, None)], "k int, url string, html string")
    rows.createOrReplaceTempView("some_pages")
    got = spark.sql("SELECT k, content_hash(html), strip_tags(html, ' '), provider_of_url(url), provider_of_page(html), url_score(url), challenge_reason(200, concat(html, 'Just a moment')) FROM some_pages ORDER BY k").collect()
    from pagelode.functions import text, urls

    c = F.col
    want = rows.orderBy("k").select(
        "k", content_hash(c("html")), text.strip_tags(c("html"), " "), detect.provider_of_url(c("url")), detect.provider_of_dom(c("html")), urls.url_score(c("url")),
        detect.challenge_reason(F.lit(200), F.concat("html", F.lit("Just a moment"))),
    ).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    with_items = spark.sql("""SELECT name, value FROM (SELECT '<p itemscope><b itemprop="a">x</b></p>' AS html), LATERAL microdata(html)""").collect()
    assert [tuple(r) for r in with_items] == [("a", "x")]


def test_links_near_and_far(spark):
    pad = " " * 300
    rows = [
        (1, f'<a href="/jobs/1/job">no</a>{pad}<a href="/JobDetail?id=4">Nurse, night</a>'), (2, 'é' * 250 + '<b aria-label="Far"></b>' + "x" * 150 + "<a href='https://o.example/x?module=jobdetail&iis=3'>ab</a>"),
        (3, None), (4, "none"), (5, '<a href="/jobs/1/job" title=" ">Cook here</a><a href="/jobs/1/job">Other one</a>'),
    ]
    found = spark.createDataFrame(rows, "k int, c string").select("k", listings.icims_links(F.col("c"), F.lit("https://h.example/a/b")).alias("l")).collect()
    assert {r["k"]: [(x["title"], x["url"]) for x in r["l"] or []] for r in found} == {
        1: [("Nurse, night", "https://h.example/JobDetail?id=4")], 2: [("Far", "https://o.example/x?module=jobdetail&iis=3")], 3: [], 4: [], 5: [("Cook here", "https://h.example/jobs/1/job")],
    }


def test_bare_arrays_are_jobs_where_they_are_asked_for(spark):
    answers = spark.createDataFrame([(1, '[{"title":"a","url":"https://x/1"},3,{"title":"b"}]'), (2, '{"jobs":[{"title":"c","url":"https://x/2"}]}'), (3, "no")], "k int, a string")
    got = {r["k"]: None if r["j"] is None else [x["title"] for x in r["j"]] for r in answers.select("k", model_output.jobs_of(F.col("a"), bare=True).alias("j")).collect()}
    assert got == {1: ["a"], 2: ["c"], 3: None}
    assert answers.where("k = 1").select(model_output.jobs_of(F.col("a"))).first()[0] is None


def test_types_in_document_order_and_no_python_without_deep_graphs(spark):
    body = '[{"@graph":[{"@type":"NewsArticle"}]},{"@type":"BlogPosting"}]'
    page = f'<script type="application/ld+json">{body}</script>'
    rows = spark.createDataFrame([(1, "https://e.example", page, "unknown")], "k int, url string, html string, provider string")
    assert validate.with_validation(rows).first()["signals"] == ["schema_non_job:NewsArticle"]
    assert rows.select(validate.json_ld_types(F.col("html"))).first()[0] == ["NewsArticle", "BlogPosting"]
    branches = validate.with_validation(rows)._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")
    assert len(branches) == 2 and "@graph" in branches[1]  # the one Python step is behind the filter on graphs


def test_split_as_of_join_equals_the_plain_one(spark):
    from pagelode.operators import incremental

    rng = random.Random(9)
    at = lambda: START + dt.timedelta(hours=rng.randrange(24 * 40))
    events = spark.createDataFrame([(rng.choice(["a", "b", "c", None]), at(), k) for k in range(120)], "url string, ts timestamp, k int")
    scrapes = spark.createDataFrame(list({(u, t): (u, t, f"h{i}") for i, (u, t) in enumerate((rng.choice(["a", "b"]), at()) for _ in range(12))}.values()), "url string, ts timestamp, content_hash string")
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.select("url", "ts", "k", "prev_ts", "prev_hash").collect())))
    want = rows(incremental.latest_before(events, scrapes))
    assert rows(incremental.latest_before_split(events, scrapes)) == want == rows(incremental.latest_before_split(events, scrapes, seconds=3600))
    assert rows(incremental.latest_before_split(events, scrapes.where("false"))) == rows(incremental.latest_before(events, scrapes.where("false")))


def test_links_that_never_end(spark):
    from pagelode.functions.text import clean_lines

    pages = [('a <a href="x">la<b>b</b>el</a> c</a> d <A HREF=\'y\'></A>e <a href="z">open', "a label (x) c\nd ye\nopen"), ('<a href=x>q</a><a href="x">foo<a href="y">bar</a>t', "q\nfoobar (y)t"), ('<a href="x">link ' * 20_000, "\n".join(["link"] * 20_000))]
    frame = spark.createDataFrame(pages, "html string, want string")
    assert [r[0] for r in frame.select(clean_lines(F.col("html"))).collect()] == [w for _, w in pages]


def test_rates_of_dense_sources(spark):
    """Against a plain count, with events without a time, a source or a status; no window holds the rows of a source's days, in SQL neither."""
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", None]), "m", START + dt.timedelta(seconds=rng.choice([rng.randrange(400_000), 86_400, 172_800])) if k % 9 else None, rng.choice(["salvaged", "clean", None])) for k in range(300)]
    events = spark.createDataFrame(rows, "event_id long, source string, model string, ts timestamp, status string")
    want = []
    for k, source, _, ts, _ in rows:
        day = [r for r in rows if r[1] == source and (r[3] is None if ts is None else r[3] is not None and ts - dt.timedelta(days=1) <= r[3] <= ts)]
        want.append((k, len(day), round(sum(r[4] == "salvaged" for r in day) / len(day), 9)))
    shape = lambda df: sorted((r["event_id"], r["n"], round(r["rate"], 9)) for r in df.collect())
    found = audit.salvage_rates(events)
    assert shape(found) == want
    events.createOrReplaceTempView("parse_events")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION salvage_rates{sql_surface.functions()['salvage_rates']}")
    in_sql = spark.sql("SELECT * FROM salvage_rates()")
    assert shape(in_sql) == want
    for df in (found, in_sql):
        assert "86400" not in "".join(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line)
