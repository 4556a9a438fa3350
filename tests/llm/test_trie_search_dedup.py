"""Prefix trie, WAND and circulant MinHash against plain versions, on small tables with nulls, ties, repeats, clashing columns and nothing at all."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from pagelode.llm import circulant_minhash, html_blocks, jaccard_join, langid, prefix_trie, tiff, wand  # noqa: E402

# 13: prefix trie


def plain_trie(rows, group=5, heads=9):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = own.get(c - c % group, [])[:h] + own[c][h:]
    members, children = {}, Counter()
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for p in members:
        if p:
            children[p[:-1]] += 1
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, n1 int, leaf string, digest string, size string, part int"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turned(spark, rows):
    return spark.createDataFrame([(*r, 1, "l", "d", "s", 2) for r in rows], TURNS)


def in_order(df):
    return sorted((tuple(r) for r in df.select(*NODE).collect()), key=str)


@pytest.mark.parametrize("seed,block", [(0, 5), (1, 4096), (2, 7)])
def test_trie_equals_a_plain_one(spark, seed, block):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-10, 150), 45):
        for t in range(rng.choice([1, 2, 3, 9, 12, 30])):
            text = rng.choice(["x", "yé", "", None]) if rng.random() < 0.7 else str(rng.random())
            rows.append((c, rng.choice([t, t, None]) if seed else t, rng.choice(["user", "a", None]) if seed > 1 else "u", text))
    rows += [(None, 1, "u", "x"), *rows[:9]]
    rng.shuffle(rows)
    assert in_order(prefix_trie.trie(turned(spark, rows).repartition(3), block=block)) == plain_trie(rows)


def test_trie_of_copies_and_of_one_long_conversation(spark):
    # A third of all turns in one conversation, and copies whose ends are many.
    rows = [(7, t, "u", f"t{t}") for t in range(1500)] + [(c, t, "u", f"c{t}") for c in range(1000, 1600) for t in range(3)]
    got = in_order(prefix_trie.trie(turned(spark, rows), block=64))
    built = {}
    for c, _, _, text in sorted(rows):
        built.setdefault(c, []).append(text)
    ends, first = Counter(), {}
    for c in built:
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(built.get(c - c % 5, [])[:h] + built[c][h:])
        ends[path] += 1
        first.setdefault(path, []).append(c)
    digests = {hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest() for cs in first.values()}
    assert {r[-1] for r in got} == digests | {hashlib.sha256().hexdigest()}
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 601 and root[5] == sum(1 for p in ends if not any(q != p and q[: len(p)] == p for q in ends))
    assert sum(r[4] for r in got) == len(got) - 1


def test_pieces_of_digests(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 60)
    rows = [(1, 2, c) for c in range(700)] + [(n, n, n) for n in range(3, 30)]
    got = {(r["n1"], r["n2"]): r["ends_sha256"] for r in prefix_trie.end_digests(spark.createDataFrame(rows, "n1 long, n2 long, conv_id long").repartition(5)).collect()}
    assert got[(1, 2)] == hashlib.sha256(",".join(map(str, range(700))).encode()).hexdigest()
    assert len(got) == 28 and got[(5, 5)] == hashlib.sha256(b"5").hexdigest()


def test_no_turns_no_nodes(spark):
    assert prefix_trie.trie(turned(spark, [])).collect() == []
    assert prefix_trie.trie(turned(spark, [(None, 1, "u", "x")])).collect() == []
    # A conversation that gives all of its turns away still has the root.
    c = next(c for c in range(1, 200) if c % 5 and prefix_trie.taken(c) > 1)
    assert in_order(prefix_trie.trie(turned(spark, [(c, 1, "u", "x")]))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


# 12: ranked search


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    tf = [(i, Counter(plain_terms(t))) for i, t in docs]
    n = sum(1 for _, c in tf if c)
    total = sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for doc, c in tf:
            m = 25 + 75 * sum(c.values()) * n // total if total else 0
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(plain_terms(text)).items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


DOCS = "doc_id long, text string, score long, rank string, terms string, q int"


@pytest.mark.parametrize("seed,shard,block", [(0, 60, 1 << 23), (1, 1 << 18, 1 << 23), (2, 25, 40)])
def test_search_equals_a_plain_one(spark, seed, shard, block):
    rng = random.Random(seed)
    words = [rng.choice("abcDEFß") + rng.choice(["", "x", "Yz", "1"]) for _ in range(40)]
    some = lambda n: " ".join(rng.choice(words[: rng.choice([5, 40])]) for _ in range(n))
    docs = [(i, some(rng.choice([0, 1, 5, 30]))) for i in rng.sample(range(1000), 70)]
    docs += [(None, some(9)), (2000, None), (2001, " \t,.!"), (2002, some(400)), *docs[:6], (5000, docs[3][1]), (5001, docs[3][1]), (2003, "a-b_c\x7fd\x00e")]
    items = [(i, some(rng.choice([1, 4, 15]))) for i in range(12)] + [(50, None), (51, "zzz"), (52, "a a A"), (None, "a b"), (0, "another text c")]
    items += items[:3]
    frame = spark.createDataFrame([(*d, 1, "r", "t", 2) for d in docs], DOCS).repartition(4)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in wand.search(wand.index(frame, shard), asked, 10, block).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain_search(docs, items)


def test_search_of_nothing(spark):
    none, asked = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert wand.search(wand.index(none), asked).collect() == []
    assert wand.search(wand.index(spark.createDataFrame([(1, "a")], "doc_id long, text string")), asked.where("false")).collect() == []


def test_shards_are_held_a_few_at_a_time(spark):
    docs = spark.range(0, 60, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a b c d e f").alias("text"))
    shards = wand.index(docs, 6)
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in shards.inputFiles()]
    assert sum(f.metadata.num_rows for f in files) >= 20
    assert max(f.metadata.row_group(g).num_rows for f in files for g in range(f.metadata.num_row_groups)) <= wand.GROUP



def test_wand_scores_only_what_may_win():
    """Documents that can't reach the heap's lowest score are skipped."""
    rng = random.Random(5)
    ids = list(range(3000))
    lists, scored = [], []

    class Counted(list):
        def __getitem__(self, i):
            scored.append(i)
            return super().__getitem__(i)

    for size, top in ((3000, 10), (1500, 20), (40, 900)):
        docs = sorted(rng.sample(ids, size))
        impacts = Counted(rng.randrange(1, top + 1) for _ in docs)
        lists.append([docs[0], 0, [*docs, 3000], impacts, max(list.__iter__(impacts))])
    want = Counter()
    for _, _, docs, impacts, _ in lists:
        for d, x in zip(docs, list.__iter__(impacts), strict=False):
            want[d] += x
    heap: list = []
    wand.wand(lists, 3000, ids, heap, 5)
    best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert sorted((-s, d) for s, _, d in heap) == sorted((-s, d) for d, s in best)
    assert len(scored) < 700


# 11: circulant MinHash


def plain_groups(rows, width=5, percent=85):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set() for w in (words(t) for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
            root[b] = a
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0]) if rows[i][0] is not None else None
    return [(d, len(sets[i]), None if d is None else least[find(i)], d is None or least[find(i)] == d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 150])
def test_near_duplicates_equal_brute_force(spark, block):
    rng, rows = random.Random(11), []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(rng.choice([3, 7, 40, 90]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = f"q{rng.random()}"
            rows.append((len(rows) * 3 % 101, rng.choice(["", " \t"]) + " ".join(w).upper()))
    rows += [(500, None), (501, ""), (502, " \n"), (None, rows[0][1]), (503, "one two"), (504, "ONE two"), rows[4]]
    frame = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, kept int, component_id string, node int")
    got = sorted(map(str, (tuple(r) for r in circulant_minhash.near_duplicates(frame, block=block).select("doc_id", "n_shingles", "component_id", "kept").collect())))
    assert got == sorted(map(str, plain_groups(rows)))
    assert circulant_minhash.near_duplicates(frame.where("false")).count() == 0


def test_both_are_permutations_and_coordinates_estimate_similarity():
    some = np.random.default_rng(1).integers(0, 1 << 32, 200_000, dtype=np.uint64).astype(np.uint32)
    for by in (circulant_minhash._SIGMA, circulant_minhash._PI):
        assert len(np.unique(circulant_minhash.permuted(np.unique(some), by))) == len(np.unique(some))
    rng = np.random.default_rng(2)
    for similar in (0.3, 0.6, 0.85):
        seen = []
        for _ in range(40):
            both = int(round(600 * similar / (1 + similar)))
            x = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
            a, b = x[:300], np.concatenate((x[:both], x[300 : 600 - both]))
            seen.append((circulant_minhash.signature(a) == circulant_minhash.signature(b)).mean())
        assert abs(np.mean(seen) - similar) < 0.03
    # One coordinate by its definition.
    s = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    places = circulant_minhash.permuted(s.astype(np.uint32), circulant_minhash._SIGMA)
    places ^= places >> np.uint32(16)
    assert circulant_minhash.signature(s)[6] == min(circulant_minhash.permuted(np.array([p + np.uint32(7)]), circulant_minhash._PI)[0] for p in places)


def test_wide_stars_are_narrowed_without_losing_a_link(spark):
    rng, rows = random.Random(3), []
    for g in range(4):
        base = [f"g{g}_{i}" for i in range(rng.choice([20, 60]))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["links"] for r in jaccard_join.jaccard_groups(frame, 90, 60, 3, narrow=99).collect()}
    assert {r["doc_id"]: r["links"] for r in jaccard_join.jaccard_groups(frame, 90, 60, 3, narrow=0).collect()} == want
    assert sum(x or 0 for x in want.values()) > 10


# 2 and 10: files that are absent or broken; comments, references and breaks as HTML has them


def test_digests_of_absent_and_broken_files(spark):
    good = tiff.encode([tiff.payload_page(b"abc")], note="3")
    rows = [(1, good), (2, None), (3, b"xx"), (4, b""), (5, good[:20]), (None, good)]
    frame = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, media binary, feature string")
    got = {r["doc_id"]: r for r in tiff.payload_digests(frame).collect()}
    assert len(got) == 6 and got[1]["n_bytes"] == 3 and got[1]["error"] is None and got[None]["payload_sha256"] == got[1]["payload_sha256"]
    for k in (2, 3, 4, 5):
        assert got[k]["error"] and got[k]["payload_sha256"] is None
    assert got[2]["media_bytes"] is None and got[3]["media_bytes"] == 2 and got[4]["media_bytes"] == 0


def test_comments_references_and_breaks():
    def text(page):
        return [b.text for b in html_blocks.blocks(page)]

    for comment in ("<!-->", "<!--->", "<!-- a --!>", "<!-- a -->", "<!---->", "<!-- > -- -->"):
        assert text(f"<p>a{comment}b</p><p>c</p>") == ["ab", "c"], comment
    assert text("<p>a<!-- b</p><p>c</p>") == ["a"]
    assert text("One</br>two<br>three") == ["One two three"]
    assert text("<p>&am<b>p;</b> &not<i>in;</i> &lt;") == ["&amp; ¬in; <"]
    assert text("<p>a</p><noscript>on</noscript><p>b<canvas>c</canvas></p>") == ["a", "on", "bc"]


# 3: language scores


def test_word_scores_equal_a_plain_scorer():
    """N-grams up to the blank behind a word, by byte, and what its script takes off, one word and language at a time."""
    rng = np.random.default_rng(4)
    langs, wide = ["de", "en", "ru"], langid.BINS * len(langid.ORDERS)
    scripts = rng.integers(1, 9, (3, len(langid.SCRIPTS) + 1)) * (rng.random((3, len(langid.SCRIPTS) + 1)) < 0.5)
    model = langid.LanguageModel.from_counts(langs, rng.integers(0, 50, (3, wide)).astype(float), scripts.astype(float))
    texts = ["Der Hund, die KATZE.", "", "the dog2cat ñandú ß", "привет мир hello", "日本 x ", "한글 é"]
    whole = "".join(t.lower() + " " for t in texts).encode()
    plain = bytes(b if 97 <= b <= 122 or 65 <= b <= 90 or b >= 128 else 32 for b in whole)

    def bin_of(k, at):
        n = langid.ORDERS[k]
        x = sum(plain[at - i] << 8 * i for i in range(n) if at >= i)
        return (x * (0x9E3779B97F4A7C15 + 2 * k) % (1 << 64) >> (64 - langid.BINS.bit_length() + 1)) + k * langid.BINS

    def script_of(char):
        return next((n for n, (_, ranges) in enumerate(langid.SCRIPTS, 1) if any(lo <= ord(char) <= hi for lo, hi in ranges)), 0)

    want = []
    for m in re.finditer(rb"[^ ]+", plain):
        script = script_of(m[0].decode()[0])
        want.append([sum(float(model.table[bin_of(k, at), c]) for at in range(m.start(), m.end() + 1) for k in range(len(langid.ORDERS))) - model.off[script, c] for c in range(3)])
    got = np.concatenate([model.word_scores(t) for _, _, t in langid.tokens(pa.array(texts))])
    assert np.allclose(got, want, atol=1e-3)
    # Narrowing: a script that some language uses is closed to those that hardly do.
    share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    for n in range(len(langid.SCRIPTS) + 1):
        uses = [share[c, n] >= langid.SCRIPT_SHARE for c in range(3)]
        assert list(model.off[n]) == [langid.OFF_SCRIPT if any(uses) and not u else 0 for u in uses]


def test_columns_named_as_an_operators_own_give_way(spark):
    from pagelode.llm import packing, queries, toxicity

    rows = [(i, "der hund und die katze" if i % 2 else "the dog and the cat", "de" if i % 2 else "en", "x", 7, "s", "p", "t", 9) for i in range(12)] + [(None, None, None, "x", 7, "s", "p", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, lang_score int, spans string, p_toxic string, toxic string, bucket int")
    found = langid.identify(docs, langid.fit(docs.where("doc_id is not null")), spans=True)
    assert sorted(found.columns) == sorted(docs.columns)
    assert {r["lang_pred"] for r in found.collect()} == {"de", "en", "und"} and all(isinstance(r["lang_score"], float) for r in found.collect())
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels, queries.TOXICITY))
    assert sorted(scored.columns) == sorted({*docs.columns, "p_low_quality"}) and {type(r["toxic"]) for r in scored.collect()} == {bool}
    packed = packing.pack(docs.withColumn("n_tokens", packing.word_count()))
    assert packed.count() == 13 and len(set(packed.columns)) == len(packed.columns)
