"""The engine's input: fetched pages as a table. Fetching itself stays outside; its contract is kept by these expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode import rules
from pagelode.functions.values import get

SCHEMA = "url string, status_code int, content string, content_type string, error string, elapsed_ms double, etag string, last_modified string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Parquet of (page_id, url, html)."""
    return spark.read.parquet(path)


def from_pages(pages: DataFrame) -> DataFrame:
    """Pages that were fetched without error, as fetches."""
    return pages.select("url", F.lit(200).alias("status_code"), F.col("html").alias("content"))


def body_data(content: Column) -> Column:
    """A body as VARIANT: its JSON, else {"raw_text": its first 500 characters}."""
    return F.coalesce(F.try_parse_json(content), F.to_variant_object(F.struct(F.left(content, F.lit(500)).alias("raw_text"))))


def with_limits(fetches: DataFrame, most: int = rules.BODY_CAP) -> DataFrame:
    """fetches with bodies over the cap refused, and bodies of failed fetches cut down into the error."""
    over = F.octet_length("content") > most
    failed = F.col("status_code") >= 400
    error = F.when(over, "response too large").when(failed, F.concat(F.lit("HTTP "), F.col("status_code"), F.lit(": "), F.left("content", F.lit(rules.ERROR_CAP))))
    return fetches.withColumn("error", F.coalesce(error, F.col("error") if "error" in fetches.columns else F.lit(None))).withColumn("content", F.when(over | failed, F.lit(None)).otherwise(F.col("content")))


def paged(responses: DataFrame, limit: int = 100, most: int = 50) -> DataFrame:
    """Of paged API answers (board, skip, content: a JSON array) those up to the first empty or short page."""
    from pyspark.sql import Window

    n = F.coalesce(F.size(get(F.try_parse_json("content"), "$", "array<variant>")), F.lit(0))
    before = Window.partitionBy("board").orderBy("skip").rowsBetween(Window.unboundedPreceding, -1)
    rows = responses.withColumn("_n", n).withColumn("_short", F.coalesce(F.max((F.col("_n") < limit).cast("int")).over(before), F.lit(0)))
    return rows.where((F.col("_short") == 0) & (F.col("_n") > 0) & (F.col("skip") < limit * most)).drop("_n", "_short")


def healthy_endpoint(endpoints: DataFrame, key: str = "kind") -> DataFrame:
    """For each key the first healthy endpoint (ord, url, healthy)."""
    return endpoints.where("healthy").groupBy(key).agg(F.min_by("url", "ord").alias("url"))


def ocr_text(answer: Column) -> Column:
    """The text of an OCR service's answer: markdown, text, content, else the first choice's message."""
    v = F.try_parse_json(answer)
    return F.coalesce(*(F.nullif(get(v, p, "string"), F.lit("")) for p in ("$.markdown", "$.text", "$.content", "$.choices[0].message.content")))
