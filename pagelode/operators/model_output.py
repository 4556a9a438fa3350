"""Listings by a language model: the answer's decoding, the ladder for cut-off answers, and the salvage of broken JSON.

The model is a callable that the caller gives: (texts, token limit) -> [(answer, was it cut off)]. It runs in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode import rules
from pagelode.functions import urls
from pagelode.functions.shipping import ship_package
from pagelode.functions.text import chunk_lines, clean_lines, let, or_null, without_fences
from pagelode.functions.values import get, is_object, kind_of, schema_salary, text

Model = Callable[[list[str], int], list[tuple[str, bool]]]
JOB = "struct<title:string,url:string,location:string,department:string,employment_type:string,description:string,requirements:array<string>,salary_range:string>"
#: Jobs as an answer gives them, whatever its fields hold.
_GIVEN = "array<struct<title:variant,url:variant,location:variant,department:variant,employment_type:variant,description:variant,requirements:variant,salary_range:variant>>"


def jobs_of(answer: Column, bare: bool = False) -> Column:
    """Array of JOB of a strict JSON answer {"jobs": [...]}, or with `bare` of an array of jobs too; null if it isn't one."""
    # Only what begins as an object or array can have jobs; a failed parse of plain text costs more than a whole one.
    body = without_fences(answer)
    v = F.try_parse_json(F.when(body.startswith("{") | body.startswith("["), body))
    listed = F.coalesce(get(v, "$.jobs", _GIVEN), get(v, "$", _GIVEN)) if bare else get(v, "$.jobs", _GIVEN)

    def row(x: Column) -> Column:
        wanted = F.filter(get(x["requirements"], "$", "array<string>"), lambda r: F.coalesce(r != "", F.lit(False)))
        said = lambda k: F.when(kind_of(x[k]) == "STRING", get(x[k], "$", "string"))
        part = lambda k: said(k).alias(k)
        return F.struct(
            or_null(said("title")).alias("title"), urls.normal(said("url")).alias("url"), part("location"), part("department"), part("employment_type"), part("description"),
            F.coalesce(wanted, F.array().cast("array<string>")).alias("requirements"), part("salary_range"),
        )

    # What is no object is null here: it has no title, so it goes with the jobs that have none.
    found = F.transform(listed, lambda x: row(x))
    return F.filter(found, lambda j: j["title"].isNotNull() & j["url"].isNotNull()).cast(f"array<{JOB}>")


def repaired(text_: str) -> str | None:
    """Valid JSON of a broken object, or null: quotes straightened, trailing commas dropped, open strings and brackets closed."""
    s = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text_.strip()))
    start = s.find("{")
    if start < 0:
        return None
    out, stack, inside, k, keep = [], [], False, start, []
    while k < len(s):
        ch = s[k]
        if inside:
            if ch == "\\":
                out.append(s[k : k + 2])
                k += 2
                continue
            inside = ch != '"'
        elif ch in "'“”":
            ch, inside = '"', True
            end = s.find(s[k] if s[k] == "'" else "”", k + 1)
            if end > 0:
                out.append(json.dumps(s[k + 1 : end]))
                inside, k = False, end + 1
                continue
        elif ch == '"':
            inside = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
            if not stack:
                out.append(ch)
                break
        out.append(ch)
        if not inside and ch in "}]":
            keep.append((len(out), list(stack)))
        k += 1
    tries = [("".join(out) + ('"' if inside else ""), stack)] + [("".join(out[:n]), st) for n, st in reversed(keep)]
    for body, closing in tries:
        body = re.sub(r",\s*([}\]])", r"\1", re.sub(r"[,:\s]+$", "", body) + "".join(reversed(closing)))
        try:
            if isinstance(json.loads(body), dict):
                return body
        except ValueError:
            continue
    return None


def salvaged_json(answer: Column) -> Column:
    ship_package()
    return F.pandas_udf(_repaired_all, "string")(answer)


def _repaired_all(answer: pd.Series) -> pd.Series:
    return answer.map(lambda x: None if x is None else repaired(x))


def with_decoded(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """rows with jobs and parse_status: clean, salvaged (after repair) or failed."""
    strict = rows.withColumn("_s", jobs_of(F.col(answer)))
    mended = strict.withColumn("_m", jobs_of(salvaged_json(F.when(F.col("_s").isNull(), F.col(answer)))))
    status = F.when(F.col("_s").isNotNull(), "clean").when(F.col("_m").isNotNull(), "salvaged").otherwise("failed")
    return mended.withColumn("jobs", F.coalesce("_s", "_m", F.array().cast(f"array<{JOB}>"))).withColumn("parse_status", status).drop("_s", "_m")


def severity(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, rules.STATUS_SEVERITY)), status)


def ask_model(pages: DataFrame, model: Model, limit: int = 4096, html: str = "html") -> DataFrame:
    """One row for each answer: url, chunk, answer, cut_off. A cut-off answer is asked again with twice the limit, then by chunks of the page."""
    ship_package(pages.sparkSession)
    asked = pages.select("url", clean_lines(F.col(html)).alias("cleaned")).withColumn("pieces", chunk_lines(F.col("cleaned")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            texts = batch["cleaned"].fillna("").tolist()
            answers = model(texts, limit)
            cut = [k for k, (_, short) in enumerate(answers) if short]
            for k, again in zip(cut, model([texts[k] for k in cut], 2 * limit) if cut else [], strict=True):
                answers[k] = again
            for k, (answer, short) in enumerate(answers):
                url = batch["url"].iloc[k]
                if short:
                    out += [(url, n, a, s) for n, (a, s) in enumerate(model(list(batch["pieces"].iloc[k]), limit))]
                else:
                    out.append((url, 0, answer, False))
            yield pd.DataFrame(out, columns=["url", "chunk", "answer", "cut_off"])

    return asked.mapInPandas(run, "url string, chunk int, answer string, cut_off boolean")


def model_listings(answers: DataFrame) -> DataFrame:
    """url, parse_status (the worst of its chunks; truncated if none was whole) and jobs (the first of equal URLs) of each page."""
    decoded = with_decoded(answers.withColumn("answer", F.when(~F.col("cut_off"), F.col("answer"))))
    per = decoded.groupBy("url").agg(
        F.max_by("parse_status", severity(F.col("parse_status"))).alias("worst"), F.max((~F.col("cut_off")).cast("int")).alias("whole"),
        F.sort_array(F.collect_list(F.struct("chunk", "jobs"))).alias("parts"),
    )

    def once(every: Column) -> Column:
        return let(F.transform(every, lambda j: j["url"]), lambda names: F.filter(every, lambda j, i: F.array_position(names, j["url"]) == i + 1))

    first = let(F.flatten(F.transform("parts", lambda p: p["jobs"])), once)
    return per.select("url", F.when(F.col("whole") == 0, "truncated").otherwise(F.col("worst")).alias("parse_status"), first.alias("jobs"))


def pipeline_first(*tiers: Column) -> Column:
    """The first tier that found something."""
    out = tiers[-1]
    for t in reversed(tiers[:-1]):
        out = F.when(F.size(t) > 0, t).otherwise(out)
    return out


def schema_jobs(answer: Column) -> Column:
    """Jobs of a schema answer ({"items": [...]} or an array); null if any item breaks the schema: all or nothing."""
    v = F.try_parse_json(without_fences(answer))
    found = F.coalesce(get(v, "$.items", "array<variant>"), get(v, "$", "array<variant>"))
    row = lambda x: F.struct(
        text(get(x, "$.title")).alias("title"), text(get(x, "$.url")).alias("url"), text(get(x, "$.location")).alias("location"),
        schema_salary(text(get(x, "$.salary_currency")), get(x, "$.salary_min", "double"), get(x, "$.salary_max", "double")).alias("salary_range"),
    )
    good = F.forall(found, lambda x: is_object(x) & text(get(x, "$.title")).isNotNull())
    return F.when(good, F.transform(found, row))
