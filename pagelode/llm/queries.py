"""The queries of this subpackage (one for each operator) and their SQL, where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import circulant_minhash, html_blocks, jaccard_join, langid, packing, prefix_trie, quality, sentencepiece_wfst, tiff, token_counts, token_parquet, toxicity, wand
from pagelode.llm.shared import shared_folder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out():
    """Rows that no language model learns from; a null doc_id counts as an empty one, whose remainder is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_wfst.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.payload_digests(tiff.text_pictures(_read(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _read(spark, sf_dir, "labels").where("quality = 1")
    return quality.judge(_read(spark, sf_dir, "documents"), trusted)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(_read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return packing.pack(docs.select("doc_id", packing.word_count().alias("n_tokens")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_parquet.write_tokens(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_parquet.with_crc32(token_parquet.read_tokens(spark, path))


#: Categories of the chain, in its order, over the columns of `labels`.
TOXICITY = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, _read(spark, sf_dir, "labels"), TOXICITY)
    return toxicity.score(docs, chain).drop("text")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.fit(pages))


def op11_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op12_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.search(wand.index(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_tiff, op3_language_id, op4_quality_rules, op5_jaccard_join,
        op6_packing, op7_token_counts, op8_token_parquet, op9_toxicity, op10_html_extraction,
        op11_circulant_minhash, op12_wand, op13_prefix_trie,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_PLAIN_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _links_sql(width: int, percent: int, columns: str) -> str:
    """Documents with the components of their links, by comparing all pairs that share a shingle."""
    shingle = " || ' ' || ".join("w[i]" if not k else f"w[i + {k}]" for k in range(width))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: {shingle})) END AS s FROM w),
reps AS (SELECT min(doc_id) AS rep, count(DISTINCT doc_id) AS copies, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
g AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM reps),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM g a JOIN g b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT rep AS x, rep AS y FROM reps UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x AS rep, min(y) AS component FROM r GROUP BY x),
l AS (SELECT e.a AS rep, sum(reps.copies) AS links FROM e JOIN reps ON e.b = reps.rep GROUP BY e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, {columns}
FROM s LEFT JOIN reps ON list_sort(s.s) = reps.s LEFT JOIN c USING (rep) LEFT JOIN l USING (rep)
"""


ORACLES: dict[str, str] = {
    "op5_jaccard_join": _links_sql(3, 90, "coalesce(c.component, s.doc_id) AS component_id,\n  CAST(coalesce(reps.copies - 1 + coalesce(l.links, 0), 0) AS BIGINT) AS n_links"),
    "op11_circulant_minhash": _links_sql(5, 85, "coalesce(c.component, s.doc_id) AS component_id, coalesce(c.component, s.doc_id) = s.doc_id AS kept"),
    "op6_packing": packing.oracle(_PLAIN_WORDS),
    "op12_wand": wand.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
