"""Corpus pipeline: toxic documents go, then those in no known language, then all but one of each group of near copies; the
rest is packed into token-budget batches. Each stage's result is written as Parquet and read again by the next.

Near copies are documents that links join: sets of 5-word shingles with a Jaccard similarity of at least 0.8.

Defined cases. Toxicity: a null or empty text gets the prior; without labels no document is toxic. Language: a null text or one
without a letter has no language and goes; documents with a null doc_id aren't learned from. Near copies: texts without words are
linked with nothing and stay; rows of one doc_id and one text are one document, of which the least row (by all columns in order)
stays; rows of one doc_id with different texts are documents of their own; a null doc_id takes part and comes last, so of a group
that also has doc_ids one with a doc_id stays; of a group the smallest doc_id stays, then the smallest hash of its set and text.
Packing: every document of the stage before, with its text; its columns named as packing's own give way. Empty tables give empty tables. Columns
besides doc_id and text pass through, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import jaccard_join, langid, packing, toxicity
from pagelode.llm.queries import TOXICITY, held_out
from pagelode.llm.shared import shared_folder

#: A document stays if one language holds at least this share of its letters.
LEAST_SHARE = 0.3
#: Words of a shingle, and the least similarity in percent, of near copies.
WIDTH, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.fit(docs, labels, TOXICITY)
    return toxicity.score(docs, chain).where(~F.col("toxic")).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(~held_out()))
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SHARE)).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component of links, and those that are linked with nothing."""
    last = F.lit((1 << 63) - 1)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("doc_id"), "text")
    found = jaccard_join.jaccard_groups(keyed, percent=percent, width=width)
    stay = found.where("n_shingles = 0 or first").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).distinct()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("_id"), F.xxhash64("text").alias("_hash"), F.struct(*docs.columns).alias("_row"))
    # Both sides are dealt by (_id, _hash): the texts move once.
    return rows.groupBy("_id", "_hash").agg(F.min("_row").alias("_row")).join(stay, ["_id", "_hash"], "left_semi").select("_row.*")


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.withColumn("n_tokens", packing.word_count()))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("packing", pack_batches),
]

#: Classifiers that are trained on the data aren't SQL: tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_folder(spark)}/pipeline-{k}-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
