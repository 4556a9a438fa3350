"""The training-data operators on small inputs, against brute force, the libraries, or an exact round trip."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from pagelode.llm import html_blocks, jaccard_join, langid, packing, quality, queries, recent, sentencepiece_wfst, tiff, token_counts, token_parquet, toxicity  # noqa: E402
from pagelode.llm.shared import word_hashes, words  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, media string, n_tokens string, bucket int, rep long, sig long, toxic string, score string, start int, ids string, page int, _w int"
LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "one two three four"), (5, "one two three four"), (6, "ONE two three four"), (None, "one two three four"), (7, "two"), (8, "Ünï cödé 😀 日本語 \x1c x"), (9, "%%% 12 !!")]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "m", "n", 7, 7, 7, "t", "s", 7, "i", 7, 7) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def shingles(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(rows, width=3, percent=90):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations([(i, s) for i, s in sets if s], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            p, q = sorted((find(i), find(j)))
            root[q] = p
    return sorted((i, len(s), find(i)) for i, s in sets)


# Words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_are_the_patterns(texts):
    raw = [t.encode("utf-8", "ignore") for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    starts, ends, row = words(data, offsets)
    assert [(int(r), data[a:b].tobytes()) for a, b, r in zip(starts, ends, row)] == [(i, w) for i, r in enumerate(raw) for w in re.findall(rb"[^\x20\x09-\x0D]+", r)]
    h = word_hashes(data, starts, ends)
    low = [data[a:b].tobytes().lower() for a, b in zip(starts, ends)]
    assert len(set(h.tolist())) == len(set(low))


# 1: SentencePiece


@pytest.fixture(scope="module")
def machine():
    return sentencepiece_wfst.transducer(PIECES)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list("abcdeinost .,\n\t") + ["é", "▁", "日", "😀", "  ", "the ", "ing"]), max_size=60).map("".join))
def test_encoding_equals_the_library(machine, library, text):
    ids = library.encode(text)
    assert machine.encode(text) == ids
    assert machine.decode(ids) == library.decode(ids)


def test_runs_of_blanks(machine, library):
    for n in range(50):
        assert machine.encode("a" + " " * n + "b") == library.encode("a" + " " * n + "b")


def test_unigram_takes_the_least_cost():
    costs = {"a": -1.0, "b": -2.0, "ab": -2.5, "ba": -1.5}
    m = sentencepiece_wfst.PieceTransducer([("<unk>", 0, 2), *((k, v, 1) for k, v in costs.items())], False, dummy_prefix=False)

    def best(x):
        return 0 if not x else max(costs[x[:k]] + best(x[k:]) for k in (1, 2) if x[:k] in costs and len(x) >= k)

    for s in map("".join, itertools.product("ab", repeat=6)):
        assert sum(costs[m.pieces[i][0]] for i in m.shortest(s)) == pytest.approx(best(s))
    assert m.encode("azzb") == [1, 0, 2]


def _message(*fields):
    """A protocol-buffer message of (number, int or float or bytes)."""
    out = b""
    for k, v in fields:
        if isinstance(v, float):
            out += bytes([k << 3 | 5]) + struct.pack("<f", v)
        else:
            n = v if isinstance(v, int) else len(v)
            size = bytearray()
            while n > 127:
                size.append(n & 127 | 128)
                n >>= 7
            size.append(n)
            out += bytes([k << 3 | (0 if isinstance(v, int) else 2)]) + bytes(size) + (b"" if isinstance(v, int) else v)
    return out


_NORMAL = [("▁", -2.0), ("a", -3.0), ("b", -3.5), ("c", -4.0), ("à", -5.0), ("1", -5.5), ("▁a", -2.25), ("ab", -2.5), ("abc", -2.75), ("▁ab", -2.125), ("ca", -4.5), ("1a", -6.0)]


@pytest.fixture(scope="module", params=[(1, False), (1, True), (2, False), (2, True)], ids=["unigram", "unigram-plain", "bpe", "bpe-plain"])
def rewriting(request, tmp_path_factory):
    """The library and the machine on a small model with the library's own table of rewrites, and user-defined pieces."""
    import sentencepiece

    kind, keep_blanks = request.param
    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    rules = next(v for k, v in sentencepiece_wfst._fields(spec) if k == 3)
    table = next(v for k, v in sentencepiece_wfst._fields(rules) if k == 2)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("<x>", 0.0, 4), ("ﬁ", 0.0, 4), *((t, s, 1) for t, s in _NORMAL)]
    model = b"".join(_message((1, _message((1, t.encode()), (2, s), (3, k)))) for t, s, k in pieces)
    model += _message((2, _message((3, kind))), (3, _message((1, b"own"), (2, table), (3, 1), (4, 0 if keep_blanks else 1), (5, 1))))
    path = tmp_path_factory.mktemp("model") / "own.model"
    path.write_bytes(model)
    return sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepiece_wfst.transducer(str(path))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("abc1 \t\n▁xf") + ["ａ", "à", "a\u0300", "①", "ﬁ", "ﬀ", "<x>", "<", "\u3000", "\u200b", "Å", "日", "  "]), max_size=24).map("".join))
def test_rewrites_and_user_pieces_equal_the_library(rewriting, text):
    library, machine = rewriting
    assert machine.encode(text) == library.encode(text)


def test_pieces_of_a_table(spark, docs, edges, nothing, library):
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in sentencepiece_wfst.digests(docs, PIECES).collect()}
    for r, ids in zip(rows, library.encode([r.text for r in rows])):
        g = got[r.doc_id]
        assert (g.n_ids, g.ids_crc32, g.decoded_same) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    back = {(r.doc_id, r.text) for r in sentencepiece_wfst.with_text(sentencepiece_wfst.with_ids(edges, PIECES), PIECES).collect()}
    assert back == {(i, t or "") for i, t in ROWS}
    assert sentencepiece_wfst.digests(nothing, PIECES).count() == 0
    with pytest.raises(ValueError):
        sentencepiece_wfst.transducer(PIECES).decode([10**6])


# 2: TIFF


@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(how, predictor, tile):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 4 if w == 50 else 256, (h, w), dtype=np.uint8) for h, w in ((1, 64), (37, 50), (1500, 64))]
    found = list(tiff.decode(tiff.encode(pages, how, predictor, tile, "n")))
    assert [p.samples for p in found] == [p.tobytes() for p in pages] and all(p.error is None and p.note == "n" for p in found)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_codecs_round_trip(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data == tiff.packbits_decode(tiff.packbits_encode(data))


def test_big_endian_planar_and_broken():
    import struct

    def field(tag, kind, count, value):
        return struct.pack(">HHI", tag, kind, count) + (struct.pack(">HH", value, 0) if kind == 3 else struct.pack(">I", value))

    body = struct.pack(">2H2H", 1, 2, 3, 4)  # two planes of one 16-bit row of two
    at = 8 + len(body)
    more = at + 2 + 12 * 9 + 4
    tags = [field(256, 3, 1, 2), field(257, 3, 1, 1), field(258, 3, 2, 16), field(259, 3, 1, 1), field(273, 4, 2, more), field(277, 3, 1, 2), field(278, 3, 1, 1), field(279, 4, 2, more + 8), field(284, 3, 1, 2)]
    tags[2] = struct.pack(">HHIHH", 258, 3, 2, 16, 16)
    data = struct.pack(">2sHI", b"MM", 42, at) + body + struct.pack(">H", 9) + b"".join(tags) + struct.pack(">I", at) + struct.pack(">4I", 8, 12, 4, 4)
    (page,) = tiff.decode(data)
    assert page.error is None and np.frombuffer(page.samples, "<u2").tolist() == [1, 3, 2, 4]
    assert [p.error for p in tiff.decode(b"nonsense")] == ["not a TIFF"]
    assert next(tiff.decode(data[:-6])).error


def test_payloads(spark, edges, nothing, docs):
    got = tiff.payload_digests(tiff.text_pictures(edges)).toPandas()
    want = {}
    for i, t in ROWS:
        raw = (t or "").encode()
        pay = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[(i, len(raw))] = (len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    assert len(got) == len(ROWS)
    for r in got.itertuples():
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[(None if np.isnan(r.doc_id) else r.doc_id, r.n_bytes)]
    assert got[got.doc_id == 5].drop_duplicates().shape[0] == 1
    assert tiff.payload_digests(tiff.text_pictures(nothing)).count() == 0
    files = spark.createDataFrame([(1, bytearray(tiff.encode([tiff.payload_page(b"a"), tiff.payload_page(b"b")])), 9), (2, None, 9), (3, bytearray(b"xx"), 9)], "k int, media binary, page int")
    assert sorted((r.k, r.page, r.error) for r in tiff.read_pages(files).collect()) == [(1, 0, None), (1, 1, None), (3, 0, "not a TIFF")]


# 3: languages


def test_language_held_out(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    got = queries.op3_language_id(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, ok = got.count(), got.where("lang = lang_pred").count()
    assert n > 150 and ok / n > 0.95
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark, edges, docs, nothing):
    model = langid.fit(docs)
    rows = langid.identify(edges, model, spans=True).collect()
    assert len(rows) == len(ROWS) and rows[0].lang == "en"
    by = {(r.doc_id, r.text): r for r in rows}
    for i, t in ROWS:
        r = by[(i, t)]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert not r.spans or (r.spans[0].first_word == 0 and sum(s.share for s in r.spans) == pytest.approx(1))
    assert langid.identify(nothing, model).count() == 0
    empty = langid.fit(nothing)
    assert {r.lang_pred for r in langid.identify(edges, empty).collect()} == {"und"}


def test_skipped_viterbi_is_viterbi(docs):
    rows = docs.select("text", "lang").toArrow()
    held = list(langid._counts(iter([pa.record_batch({"text": rows["text"].combine_chunks(), "lang": rows["lang"].combine_chunks()})]), "text", "lang"))
    langs = sorted(b["lang"][0].as_py() for b in held)
    table = np.zeros((len(langs), langid.BINS * len(langid.ORDERS) + len(langid.SCRIPTS) + 1))
    for b in held:
        table[langs.index(b["lang"][0].as_py()), b["bin"].to_numpy()] = b["n"].to_numpy()
    cut = langid.BINS * len(langid.ORDERS)
    model = langid.LanguageModel.from_counts(langs, table[:, :cut], table[:, cut:])
    texts = rows["text"].to_pylist()
    mixed = [" ".join(a.split()[:9] + b.split()[:9]) for a, b in zip(texts[:60], texts[60:120])]
    for lo, hi, t in langid.tokens(pa.array(texts[:60] + mixed)):
        s = model.word_scores(t)
        label = model.labels(s, t.row, hi - lo)
        for d in range(hi - lo):
            own = t.row == d
            if own.any():
                assert (model.viterbi(s[own]) == label[own]).all()


# 4: quality


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for x in win:
        seen[x] = seen.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(win) if seen[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base(spark, docs, edges):
    odd = spark.createDataFrame([(100 + k, t) for k, t in enumerate(["a b c a b c", "a a a a", "x\n\nx\n x\nx", "<a|b> #", "p q r s p q r", "\x0b\x0cz"])], "doc_id long, text string")
    for df in (docs, edges, odd):
        for r in quality.base_counts(quality.with_words(df)).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(r.text)


def test_quality_score_equals_brute_force(spark, docs, data):
    import math

    import xxhash

    trusted = spark.read.parquet(f"{data}/labels.parquet").where("quality = 1")
    good = {r.doc_id for r in trusted.collect()}

    def bucket(*ws):
        seed = 42
        for x in ws:
            seed = xxhash.xxh64_intdigest(x.encode(), seed)
        return (seed - (1 << 64) if seed >> 63 else seed) % 4096

    grams = {r.doc_id: [bucket(x) for x in w] + [bucket(*p) for p in zip(w, w[1:])] for r in docs.collect() for w in [re.findall(r"[^\x20\x09-\x0D]+", r.text or "")]}
    raw, target = np.ones(4096), np.ones(4096)
    for i, g in grams.items():
        np.add.at(raw, g, 1)
        if i in good:
            np.add.at(target, g, 1)
    ratio = [math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1) for x in np.log((target / target.sum()) / (raw / raw.sum())) * quality.FIXED_POINT]
    for r in quality.judge(docs, trusted, buckets=4096).collect():
        g = grams[r.doc_id]
        assert r.score == pytest.approx(sum(ratio[b] for b in g) / len(g), abs=1.0) if g else r.score is None


def test_quality_edges(spark, edges, nothing, docs):
    none = nothing.select("doc_id")
    rows = quality.judge(edges, none).collect()
    assert len(rows) == len(ROWS) and all(r.kept == (not r.base_failed) for r in rows)
    assert quality.judge(nothing, docs.select("doc_id")).count() == 0


def test_trusted_rows_all_count(spark):
    """More trusted rows than the bound of 20,000 that was there: each is marked, and the threshold is the exact quantile of all scores."""
    ids = spark.range(-500, 21_500).select((F.col("id") * 3).alias("doc_id"))
    trusted = ids.where("doc_id % 2 = 0 or doc_id > 3000").select("doc_id").union(spark.createDataFrame([(None,), (1,)], "doc_id long"))
    want = {r[0] for r in trusted.join(ids, "doc_id").select("doc_id").collect()}
    assert len(want) > 20_000
    bits = quality.bitmaps(trusted)
    marked = quality.with_trust(ids.select("doc_id"), bits)
    assert {r[0] for r in marked.where("_t = 1").collect()} == want and marked.count() == 22_000
    scores = spark.range(1000).select((F.col("id") * 0.37 % 11).alias("score"))
    for q in (0.0, 0.001, 0.0137, 0.5, 1.0):
        assert abs(quality.percentile(scores, q).first()[0] - np.percentile([r[0] for r in scores.collect()], 100 * q)) < 1e-9
    assert quality.percentile(scores.where("false"), 0.001).first()[0] is None



def test_quality_keeps_trusted(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = queries.op4_quality_rules(spark, big).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 0.99 and kept[0] < 0.1


# 5: Jaccard join


@pytest.fixture(scope="module")
def near():
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(200)]
    rows = []
    for k in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 12, 25, 60, 150]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_divide_skip_is_counting(near):
    sets = list(jaccard_join.shingle_sets(pa.array([t for _, t in near])))
    index = {}
    for i, s in enumerate(sets):
        for x in s.tolist():
            index.setdefault(x, []).append(i)
    for s in sets[::5]:
        for least in (1, 2, 4, max(1, len(s) // 2), len(s)):
            want = {j: n for j, t in enumerate(sets) if (n := len(np.intersect1d(s, t))) >= least}
            assert jaccard_join.divide_skip(index, s.tolist(), least) == want


def test_signatures_cover_all_links(near):
    sets = list(jaccard_join.shingle_sets(pa.array([t for _, t in near])))
    signs = [set(jaccard_join.signatures(s).tolist()) for s in sets]
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
            assert signs[i] & signs[j]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 600))
def test_linked_sizes_share_a_class_with_enough_parts(a, more):
    b = min(a + more, a * 100 // 90)
    shared = set(jaccard_join._classes(a, 90)) & set(jaccard_join._classes(b, 90))
    assert any(parts > 10 * (a + b) // 190 for _, parts in shared)


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 150])
def test_components_equal_brute_force(spark, near, block):
    df = spark.createDataFrame(near, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.jaccard_components(df, block=block).collect()))
    assert got == brute_components(near)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 1300))
def test_linked_sizes_share_a_class_at_80(a, more):
    b = min(a + more, a * 100 // 80)
    shared = set(jaccard_join._classes(a, 80)) & set(jaccard_join._classes(b, 80))
    assert any(parts > 20 * (a + b) // 180 for _, parts in shared)


def shingles_of(text, width):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def linked_pairs(rows, width, percent):
    sets = [shingles_of(t, width) for _, t in rows]
    return [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


@pytest.fixture(scope="module")
def near_five(near):
    base = [f"u{i}" for i in range(345)]
    rows = [t for _, t in near]
    rows += [" ".join(base[:50]), " ".join(base[:20] + ["other"] + base[21:50])]  # 0.804 on five words, 0.882 on three
    rows += [" ".join(base[45:]), " ".join(base[45:200] + base[:45] + base[200:])]  # 45 words put into 300
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 150])
def test_five_words_and_80_percent_equal_brute_force(spark, near_five, block):
    root = {i: i for i, _ in near_five}
    pairs = linked_pairs(near_five, 5, 80)
    assert len(pairs) > len(linked_pairs(near_five[:-4], 5, 80))
    for i, j in pairs:
        p, q = sorted((root[i], root[j]))
        root = {k: p if v == q else v for k, v in root.items()}
    got = jaccard_join.jaccard_components(spark.createDataFrame(near_five, "doc_id long, text string"), percent=80, block=block, width=5).collect()
    assert sorted(map(tuple, got)) == [(i, len(shingles_of(t, 5)), root[i]) for i, t in near_five]


def test_stage_takes_five_words_and_80_percent(spark, near_five):
    import corpus_pipeline as cp

    few = spark.createDataFrame(near_five[-4:], "doc_id long, text string")
    first = near_five[-4][0]
    assert sorted(r.doc_id for r in cp.keep_one_of_each_group(spark, few, "").collect()) == [first, first + 2]
    assert cp.keep_one_of_each_group(spark, few, "", width=3, percent=90).count() == 4


def test_lists_find_what_divide_skip_finds(near):
    sets = sorted(jaccard_join.shingle_sets(pa.array([t for _, t in near])), key=len)
    lists = jaccard_join.Lists(sets)
    for i in range(0, len(sets), 5):
        index = {}
        for j, s in enumerate(sets[:i]):
            for x in s.tolist():
                index.setdefault(x, []).append(j)
        for least in (1, 2, 4, max(1, len(sets[i]) // 2), len(sets[i])):
            want = jaccard_join.divide_skip(index, sets[i].tolist(), least)
            assert dict(zip(*(x.tolist() for x in lists.before(i, 0, least)))) == want
            assert dict(zip(*(x.tolist() for x in lists.before(i, i // 2, least)))) == {j: n for j, n in want.items() if j >= i // 2}


@pytest.mark.parametrize("width,percent,block", [(3, 90, jaccard_join.BLOCK), (3, 90, 150), (5, 80, 150)])
def test_every_link_counts_once(spark, near_five, width, percent, block):
    rows = list(enumerate([t for _, t in near_five + near_five[:60:7]]))
    want = dict.fromkeys((i for i, _ in rows), 0)
    for i, j in linked_pairs(rows, width, percent):
        want[i] += 1
        want[j] += 1
    assert max(want.values()) > 5
    odd = [rows[3], (None, rows[3][1]), (999, ""), (998, None)]  # a repeated row is no document of its own, a null doc_id has no links
    got = jaccard_join.jaccard_links(spark.createDataFrame(rows + odd, "doc_id long, text string"), percent, block, width).collect()
    assert len(got) == len(rows) + len(odd)
    assert {r.doc_id: r.n_links for r in got} == want | {None: None, 999: 0, 998: 0}


def test_join_edges(spark, edges, nothing):
    got = jaccard_join.jaccard_components(edges).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[(1, 0)] == 1 and by[(2, 0)] == 2 and by[(5, 2)] == 5 and by[(6, 2)] == 5 and by[(None, 2)] is None and by[(7, 1)] == 7
    assert jaccard_join.jaccard_components(nothing).count() == 0


# 6: packing


def test_buckets_are_optimal():
    rng = random.Random(2)
    for _ in range(200):
        lengths = sorted(rng.sample(range(50), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = min(rng.randrange(1, 5), len(lengths))

        def cost(uppers):
            return sum(c * (min(u for u in uppers if u >= x) - x) for x, c in zip(lengths, counts))

        got = packing.boundaries(lengths, counts, k)
        assert len(got) == k and cost(got) == min(cost((*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], k - 1))


def test_packing_edges(spark, edges, nothing):
    rows = packing.pack(edges.withColumn("n", packing.word_count()), "n", budget=100).collect()
    assert len(rows) == len(ROWS)
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket, r.shard, r.batch), []).append(r)
    for group in batches.values():
        assert len(group) == 1 or len(group) * group[0].bucket_length <= 100 or group[0].bucket_length == 0
        assert sorted(r.slot for r in group) == list(range(len(group)))
    assert packing.pack(nothing.withColumn("n", F.lit(1)), "n").count() == 0


# 7 and 8: tokens


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(list("abcABC'  \n\t.,!12") + ["é", "́", "İ", "Σ", "\x1c", "\x85", "\xa0", "日", "😀", "<|endoftext|>", "<|", "\x0b"]), max_size=50).map("".join))
def test_pretokens_add_up(text):
    e = recent.PretokenEncoder.of(WORDS)
    ids = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.pack_texts([text])[0], "<u2").tolist() == ids
    assert token_counts.counts(pa.array([text]), e) == [len(ids)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x180, categories=["L", "P", "S", "N", "M"]), min_size=1, max_size=9) | st.sampled_from(["WORD###", "été!!'", "'s's", "ﬁ,", "ǅa", "e\u0301"]), max_size=9))
def test_letters_and_marks_equal_the_library(parts):
    e = recent.PretokenEncoder.of(WORDS)
    e.packed = recent.Recent(20)
    text = " ".join(parts)
    assert np.frombuffer(e.pack_texts([text])[0], "<u2").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_small_cache_gives_the_same():
    e = recent.PretokenEncoder(WORDS)
    e.packed, e.counts = recent.Recent(4), recent.Recent(4)
    texts = ["a b c d e f g a b c", "Word, word. word WORD", "a a a"] * 3
    assert [np.frombuffer(p, "<u2").tolist() for p in e.pack_texts(texts, 3)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert token_counts.counts(pa.array(texts), e) == [len(e.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_tables(spark, docs, edges, nothing, tmp_path):
    tok = recent.PretokenEncoder.of(WORDS).tokenizer
    for name, df in (("docs", docs), ("edges", edges)):
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
        ids = [tok.encode(t, add_special_tokens=False).ids for _, t in rows]
        got = sorted((r.doc_id is not None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, WORDS).collect())
        assert got == sorted((i is not None, i, len(t.encode()), len(x), len(x) > 2048) for (i, t), x in zip(rows, ids))
        path = str(tmp_path / name)
        token_parquet.write_tokens(df, path, WORDS)
        back = token_parquet.with_crc32(token_parquet.read_tokens(spark, path)).orderBy("start").collect()
        start, want = 0, []
        for (i, _), x in zip(rows, ids):
            x = [*x, 2]
            want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
            start += len(x)
        assert [tuple(r) for r in back] == want
    token_parquet.write_tokens(nothing, str(tmp_path / "none"), WORDS)
    assert token_parquet.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_token_files_have_dictionaries_and_indexes(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    token_parquet.write_tokens(docs, path, WORDS)
    part = next(p for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet")
    column = next(c for c in (pq.ParquetFile(part).metadata.row_group(0).column(i) for i in range(5)) if c.path_in_schema.startswith("ids"))
    assert column.has_dictionary_page and column.has_offset_index
    plan = token_parquet.read_tokens(spark, path, ids=False)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1][:200]


# 9: toxicity


@pytest.mark.xfail(reason="not met yet: fitted on the 2,650 learning rows of sf0.1 the chain finds 130 of 147 toxic texts, with 10 false ones", strict=False)
def test_chain_parts_toxic_texts(spark, data):
    big = data.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    learn, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    chain = toxicity.fit(docs, learn, queries.TOXICITY)
    got = toxicity.score(docs.select("doc_id", "text"), chain).withColumnRenamed("toxic", "pred").join(held, "doc_id").groupBy("toxic", "pred").count().collect()
    n = {(r.toxic, r.pred): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.05 * n[(1, True)] and n.get((0, True), 0) <= 0.005 * n[(0, False)]
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1


def test_scores_are_those_of_a_plain_chain(docs, spark, data):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [(r.text or "", labels[r.doc_id]) for r in docs.select("doc_id", "text").collect() if r.doc_id in labels] + [("", None), ("Ünï 7", None)]
    known = [(t, m) for t, m in rows if m is not None]
    marks = np.array([[float(m.quality == 0), float(m.toxic == 1)] for _, m in known])
    chain = toxicity.ToxicityChain.fit(pa.array([t for t, _ in known]), marks, ["low_quality", "toxic"])
    place = {h: k for k, h in enumerate(chain.hashes.tolist())}

    def hashed(w):
        return int(word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])

    for (text, _), got in zip(rows, chain.predict(pa.array([t for t, _ in rows])), strict=True):
        words_ = {w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode())}
        parts = words_ | {w[:k] for w in words_ for k in toxicity.PREFIXES if len(w) > k}
        present = {place[h] for h in map(hashed, parts) if h in place}
        earlier = []
        for w in chain.weights:
            z = sum(w[k] for k in present) + sum(w[len(place) + k] * p for k, p in enumerate(earlier)) + w[-1]
            earlier.append(1 / (1 + np.exp(-z)))
        assert got == pytest.approx(earlier, abs=1e-9)


def test_toxicity_edges(spark, edges, nothing, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    chain = toxicity.fit(docs, labels, queries.TOXICITY)
    rows = toxicity.score(edges, chain).collect()
    assert len(rows) == len(ROWS) and rows[0].source == "s" and len({r.p_toxic for r in rows if not (r.text or "").strip()}) == 1
    blank = toxicity.fit(docs, labels.where("false"), queries.TOXICITY)
    assert not any(r.toxic for r in toxicity.score(edges, blank).collect())
    assert toxicity.score(nothing, chain).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    toxicity.fit(edges, nulls, queries.TOXICITY)


# 10: pages


@pytest.fixture(scope="module")
def labeller(spark, data):
    return html_blocks.fit(spark.read.parquet(f"{data}/pages.parquet"))


def test_articles(spark, data, labeller):
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = {r.page_id: r for r in html_blocks.extract(spark.createDataFrame(pages), labeller).collect()}
    import html as h

    for p in pages:
        body = re.search(r"(?s)<article>(.*?)</article>", p.html)[1]
        parts = [" ".join(h.unescape(re.sub(r"</?(b|br)>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        text = "\n".join(x for x in parts if x)
        assert got[p.page_id].text == text and got[p.page_id].n_chars == len(text)


def test_other_layouts(labeller):
    def text(page):
        (found,) = [html_blocks.blocks(page)]
        return [b.text for b, k in zip(found, labeller.labels([found])[0]) if k]

    prose = "It was a long day and the rain did not stop until the evening came."
    page = f'<body><header><a href="/">Home</a></header><div class="sidebar"><p>{prose} Side.</p></div><main><h1>Title of it</h1><p>{prose}</p><ul><li>First point</li></ul></main><div class="comments"><div class="comment"><p>{prose} No!</p></div></div><footer>Imprint</footer></body>'
    assert text(page) == ["Title of it", prose, "First point"]


def test_blocks():
    found = [b.text for b in html_blocks.blocks("<p>a&amp;b <b>c</b>d<br>e<p>f<ul><li>x<li>y</ul>z<script>if(a<b)</script><!-- no --> &am &lt; <style>q")]
    assert found == ["a&b cd e", "f", "x", "y", "z &am <"]
    assert html_blocks.blocks(None) == html_blocks.blocks("") == []


def test_nothing_behind_an_empty_svg_or_in_math_is_lost():
    def text(page):
        return [b.text for b in html_blocks.blocks(page)]

    assert text('<article><p>a <svg class="i"/> b</p><p>c</p></article>') == ["a b", "c"]
    assert text("<p>a<svg/>b<SVG viewBox='0 > 1' />c<math/>d</p><p>e") == ["abcd", "e"]
    assert text('<p>a <svg class="i"><path d="m"/><text>no</text></svg> b</p>') == ["a b"]
    assert text("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p><p>c") == ["a x=1 b", "c"]
    assert text("<p>a <object>old</object> <audio controls>sound</audio> <video><source src=s>film</video> b") == ["a old sound film b"]
    marked = html_blocks.blocks("<article><p>a<math/>b</p></article><p>c")
    assert [b.path for b in marked] == [("article", "p"), ("p",)]


def test_gradient_of_the_labeller():
    rng = np.random.default_rng(0)
    model = html_blocks.BlockLabeller.fresh()
    x, sizes = html_blocks.padded([rng.normal(size=(n, html_blocks.PATH_BINS + html_blocks.WORD_BINS + html_blocks.MEASURES)).astype(np.float32) * 0.3 for n in (4, 2)])
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    y = (rng.random(x.shape[:2]) > 0.5).astype(float)
    _, grads = model.gradient(x, sizes, y)
    for name, place in (("o", (3,)), ("fx", (5, 7)), ("bh", (2, 9)), ("fb", (1,)), ("bx", (100, 30))):
        w, step = model.weights[name], 1e-4
        old = w[place]
        w[place] = old + step
        up = model.gradient(x, sizes, y)[0]
        w[place] = old - step
        down = model.gradient(x, sizes, y)[0]
        w[place] = old
        assert grads[name][place] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-4)


def test_page_edges(spark, labeller):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav>x"), (None, "u", "<article><p>t" + "<p>word word." * 3000), (3, "u", "<nav>x")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_blocks.extract(df, labeller).collect()
    assert len(got) == 5 and all(r.text == "" for r in got if r.page_id is not None)
    assert next(r for r in got if r.page_id is None).text.count("\n") > 2500
    assert html_blocks.extract(df.where("false"), labeller).count() == 0


# Queries with SQL, and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, data, duck, same, name):
    same(queries.QUERIES[name](spark, data).toPandas(), duck.execute(queries.ORACLES[name]).df())


def test_pipeline(spark, data, docs):
    import corpus_pipeline as cp

    rows = docs
    for name, stage in cp.STAGES:
        before, rows = rows, stage(spark, rows, data)
        if name != "packing":
            assert rows.columns == docs.columns
            rows = spark.createDataFrame(rows.toPandas(), docs.schema)
        if name == "ngram_jaccard_join":
            have = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(r.doc_id for r in rows.collect()) == sorted({c for _, _, c in brute_components(have, 5, 80)})
            three = cp.keep_one_of_each_group(spark, before, data, width=3, percent=90)
            assert sorted(r.doc_id for r in three.collect()) == sorted({c for _, _, c in brute_components(have, 3, 90)})
    assert sorted(r.doc_id for r in rows.collect()) == sorted(r.doc_id for r in cp.run(spark, data).collect())


def test_pipeline_stages_on_edges(spark, edges, nothing, data):
    import corpus_pipeline as cp

    for name, stage in cp.STAGES:
        assert stage(spark, nothing, data).count() == 0
        out = stage(spark, edges, data)
        if name != "packing":
            assert out.columns == edges.columns
        n = out.count()
        # Of ROWS, a repeated row, one in capitals and one without a doc_id are copies of doc_id 5.
        assert n == (len(ROWS) - 3 if name == "ngram_jaccard_join" else n)
        assert "text" in out.columns


def test_one_document_of_each_group(spark):
    import corpus_pipeline as cp

    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long, "b"), (1, long, "a"), (1, "other words stand here now", "c"), (2, long + " end", "d"), (None, long, "e"), (None, "one of its own it is", "f"), (None, "one of its own it is", "f"), (3, None, "g"), (4, "", "h"), (4, "", "h")]
    got = cp.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted(r.lang for r in got) == ["a", "c", "f", "g", "h"]


def test_two_sets_of_one_doc_id_stay_apart(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    rows = [(7, a), (7, b), (8, a + " z"), (9, b + " z"), (9, b + " z")]
    got = jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.collect()) == [(7, 98, 7, 1)] * 2 + [(8, 99, 7, 1)] + [(9, 99, 7, 1)] * 2
    classes = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).where("first").collect()
    assert sorted((r.doc_id, r.n_shingles) for r in classes) == [(7, 98), (7, 98)]


def test_linked_sets_share_enough_of_their_prefixes(near_five):
    sets = [s for s in jaccard_join.shingle_sets(pa.array([t for _, t in near_five]), 5) if len(s)]
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    for often in (jaccard_join.Often(values[:0], counts[:0]), jaccard_join.Often(values[counts > 4], counts[counts > 4])):
        for a, b in itertools.combinations(sets, 2):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                shared = np.intersect1d(jaccard_join.prefix(a, 80, often), jaccard_join.prefix(b, 80, often))
                assert len(shared) >= 1 + -(-80 * min(len(a), len(b)) // 100) // jaccard_join.EXTRA


def test_a_filter_copies_the_quality_plan_once(spark, docs, data):
    rows = quality.judge(docs, spark.read.parquet(f"{data}/labels.parquet").where("quality = 1"))
    sorts = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("sort_array")
    plain = sorts(rows)
    assert 1 <= plain <= 2
    for condition in ("not base_failed", "kept", "n_repeat_words > 3"):
        assert sorts(rows.where(condition)) <= 2 * plain


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=8) | st.sampled_from(["×", "÷ ×", "٣٤", "१२", "ª", "ß", "日本", "Ω", "a×", "𝔸", "𐍈 1", "İ", "€"]))
def test_undetermined_without_a_letter(text):
    counts = np.zeros((2, langid.BINS * len(langid.ORDERS)))
    model = langid.LanguageModel.from_counts(["aa", "bb"], counts, np.ones((2, len(langid.SCRIPTS) + 1)))
    text = text.encode("utf-8", "ignore").decode()
    ((lang, score, spans),) = list(model.predict(pa.array([text])))
    assert (lang == "und") == (not any(c.isalpha() for c in text.lower()))
    assert 0 <= score <= 1 and (lang == "und") == (spans == [])


def test_quotes_open_a_value_behind_an_equals_sign_only():
    def text(page):
        return [b.text for b in html_blocks.blocks(page)]

    assert text("<p title=it's>I don't know</p><p>World</p>") == ["I don't know", "World"]
    assert text("<p title=it's>Hello</p>") == ["Hello"]
    assert text("<p ' \" x>a</p><p a='>' b=\">\">b</p>") == ["a", "b"]
    assert text("<svg title=it's><path/></svg>a<script x=it's>b</script>c") == ["ac"]
    (b,) = html_blocks.blocks("<div title='class=ad' data-id=menu CLASS=\"main text\"><p>x")
    assert b.path == ("div.main.text", "p")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "<b x='>'>", "<i a=b'c>", "</i>", "t", " u ", "'", '"', "=", "<br/>", "<a href=\"x>y\">", "</a>", "<!-- c -->"]), max_size=25).map("".join))
def test_no_text_is_lost_by_the_tokeniser(page):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.held = []

        def handle_data(self, data):
            self.held.append(data)

    plain = Plain()
    plain.feed(page)
    plain.close()
    got = "".join("".join(b.text for b in html_blocks.blocks(page)).split())
    assert got == "".join("".join(plain.held).split())


def test_contradicting_labels_and_repeated_ids(spark):
    rows = [(i, f"word{i % 7} good text number {i}" if i % 2 else f"bad evil text number {i}") for i in range(60)]
    labels = [(i, 1, 1 - i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    schema = "doc_id long, quality int, toxic int"
    one = toxicity.fit(docs, spark.createDataFrame(labels, schema), queries.TOXICITY)
    two = toxicity.fit(docs.union(docs), spark.createDataFrame(labels + labels, schema), queries.TOXICITY)
    assert all((a == b).all() for a, b in zip(one.weights, two.weights))
    less = toxicity.fit(docs.where("doc_id <> 3"), spark.createDataFrame(labels, schema), queries.TOXICITY)
    odd = toxicity.fit(docs, spark.createDataFrame(labels + [(3, 1, 1)], schema), queries.TOXICITY)
    assert all((a == b).all() for a, b in zip(less.weights, odd.weights))


def test_shortcuts_are_off_for_a_vocabulary_that_tells_cases_apart(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    kinds = {x: i for i, x in enumerate(["[u]", *"thebTHEaspr", ".</w>", ",</w>", "e</w>", "E</w>"])}
    t = Tokenizer(models.BPE(kinds, [], unk_token="[u]", end_of_word_suffix="</w>"))
    t.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    t.save(str(tmp_path / "v.json"))
    encoder = recent.PretokenEncoder(str(tmp_path / "v.json"))
    assert encoder.ends is None
    parts = ["The", "THE", "the,", "tHe."]
    assert [np.frombuffer(p, "<u2").tolist() for p in encoder.pack_all(parts)] == [t.encode(p).ids for p in parts]
    assert recent.PretokenEncoder.of(WORDS).ends is not None
