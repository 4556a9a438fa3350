"""Quality rules and a hashed n-gram importance score, in DataFrame and SQL functions only.

Base rules (counts over the words [^\\x20\\x09-\\x0D]+ of a text): see base_counts().

Score: the log-likelihood ratio of a text's hashed word n-grams (N_GRAMS) under two multinomials, one over
the trusted rows and one over all rows, divided by the number of n-grams. Its verdict is a threshold: the
QUANTILE of the trusted rows' own scores less a MARGIN, so that what looks like the trusted rows stays.

Both multinomials are counted over all their rows, and the quantile is that of all trusted rows. Trusted ids are kept as bitmaps of
32,768 neighbouring ids, so that a text needs no shuffle to know whether it is trusted: ids that lie close take about one bit each. Log
ratios are rounded to 2**-16 and summed as integers: the order of summation can't move a verdict.

Windows of three words are compared by their 64-bit hash: a text of a million words confuses two once in 10**7 texts.

Defined cases: a null, empty or wordless text has no words and fails the base; without trusted rows nothing
is known against a text and only the base decides; repeated rows count each; other columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions.text import let
from pagelode.llm.shared import saved

BUCKETS = 1 << 16
N_GRAMS = (1, 2)
QUANTILE = 0.001
#: Taken off that quantile (units of 2**-16): texts that the multinomials weren't counted on score somewhat lower.
MARGIN = 2048
LEAST_WORDS = 50
#: Percent of words in repeated windows above which the base fails.
MOST_REPEATED = 50
#: Added to each bucket's count.
SMOOTH = 1.0
FIXED_POINT = 1 << 16

_WORD = r"[^\x20\x09-\x0D]"


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the array `_w` of words."""
    # A split leaves an empty string at either end at most.
    return docs.withColumn("_w", F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), ""))


def base_counts(worded: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to rows with `_w`.

    n_repeat_words: words in windows of three words that occur at least twice in the text. The windows, each its hash and then its
    place, are sorted, so that equal ones lie side by side; the places of those are sorted again, and each adds the words up to the next
    place, three at most. What is used twice is bound inside the expression: a filter above copies it once, not for every use."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(_WORD))
    repeated = let(
        F.col("_w"),
        lambda w: F.when(F.size(w) >= 4, let(F.sort_array(_windows(w)), lambda s: let(F.sort_array(_twice(s)), _covered))).otherwise(F.lit(0).cast("long")),
    )
    return worded.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_repeat_words": repeated,
        }
    )


def _windows(w: Column) -> Column:
    """(hash, place) of each window of three words."""
    firsts = F.slice(w, F.lit(1), F.size(w) - 2)
    return F.transform(firsts, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")))


def _twice(s: Column) -> Column:
    """The places of the sorted windows whose hash is also that of a neighbour."""
    at = lambda i: F.get(s, i)["h"]
    return F.array_compact(F.transform(s, lambda x, i: F.when(F.coalesce(x["h"] == at(i - 1), F.lit(False)) | F.coalesce(x["h"] == at(i + 1), F.lit(False)), x["at"])))


def _covered(p: Column) -> Column:
    """How many words windows at these places hold."""
    upto = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    return F.aggregate(upto, F.lit(0).cast("long"), lambda a, x: a + x)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def gram_buckets(buckets: int = BUCKETS) -> Column:
    """The buckets of the n-grams of `_w`."""

    def of(w: Column, n: int) -> Column:
        firsts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))
        return F.transform(
            firsts, lambda x, i: F.pmod(F.xxhash64(x, *(F.get(w, i + k) for k in range(1, n))), F.lit(buckets)).cast("int")
        )

    return let(F.col("_w"), lambda w: F.concat(*(of(w, n) for n in N_GRAMS)))


def bitmaps(trusted: DataFrame) -> DataFrame:
    """The distinct doc_id of rows as bits: _bucket and _bits, a row for each 32,768 neighbouring ids that has one."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    place = F.bitmap_bit_position("doc_id")
    return ids.groupBy(F.bitmap_bucket_number("doc_id").alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_bits"))


def with_trust(docs: DataFrame, bits: DataFrame) -> DataFrame:
    """docs with `_t`: 1 where doc_id is among the ids of bitmaps(), else 0."""
    place = F.bitmap_bit_position(F.col("doc_id").cast("long"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte, (place % 8).cast("int")).cast("int"), F.lit(0))
    return docs.join(bits, F.bitmap_bucket_number(F.col("doc_id").cast("long")) == F.col("_bucket"), "left").withColumn("_t", bit).drop("_bucket", "_bits")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with the array `ratios`: for each bucket round(2**16 * ln(trusted share / corpus share)).

    trusted: bitmaps() of trusted rows."""
    marked = with_words(with_trust(docs.select("doc_id", "text"), trusted))
    # Partial sums leave each task with one row for each bucket at most.
    counts = (
        marked.select(F.explode(gram_buckets(buckets)).alias("bucket"), "_t")
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("_t").alias("target"))
    )
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select(
        "bucket", (F.coalesce("raw", F.lit(0)) + SMOOTH).alias("raw"), (F.coalesce("target", F.lit(0)) + SMOOTH).alias("target")
    )
    row = filled.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("all"), F.sum("raw").alias("r"), F.sum("target").alias("t"))
    ratio = F.transform("all", lambda x: F.round(F.log((x["target"] / F.col("t")) / (x["raw"] / F.col("r"))) * FIXED_POINT).cast("int"))
    return row.select(ratio.alias("ratios"))


def score_column(grams: Column, ratios: Column) -> Column:
    """The mean log ratio of a text's n-grams in units of 2**-16; null without n-grams."""
    total = lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda a, b: a + F.get(ratios, b))
    return let(grams, lambda g: F.try_divide(total(g), F.size(g)))


def percentile(rows: DataFrame, quantile: float) -> DataFrame:
    """One row with the exact quantile of `score`, interpolated, or null: what lies below it is ordered, and no task holds all scores."""
    known = rows.where("score is not null").select("score")
    at = quantile * max(known.count() - 1, 0)
    two = known.orderBy("score").offset(math.floor(at)).limit(2)
    part = at - math.floor(at)
    return two.agg((F.min("score") + (F.max("score") - F.min("score")) * part).alias("score"))


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every row of docs; trusted holds the doc_id of trusted rows."""
    slim = docs.select("doc_id", "text")
    bits = saved(bitmaps(trusted), "trusted")
    ratios = saved(log_ratios(slim, bits, buckets), "ratios").scalar()

    def scored_(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_m", ratios).withColumn("score", score_column(gram_buckets(buckets), F.col("_m")))

    own = saved(scored_(with_words(with_trust(slim, bits).where("_t = 1"))).select("score"), "scores")
    limit = saved(percentile(own, quantile).select((F.col("score") - MARGIN).alias("limit")), "limit")
    scored = scored_(base_counts(with_words(slim)))
    failed = base_failed()
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score",
        (~failed & (F.coalesce(F.col("score") >= limit.scalar(), F.lit(True)))).alias("kept"),
    )
