"""Extraction in tiers: structured data first, then a local model over the page's Markdown, then a hosted model over its text lines.

Each later tier is asked only about pages in which the earlier ones found nothing. Models are callables that the caller gives; they
run in Arrow batches. A page without text, a null one and an answer that breaks its schema have no jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelode import rules
from pagelode.functions.shipping import ship_package
from pagelode.functions.text import clean_lines, let, or_null, strip, without_fences
from pagelode.functions.values import base_salary, get, is_object, iso_time, kind_of, schema_salary, text
from pagelode.operators.listings import json_ld_postings
from pagelode.operators.microdata import flat, items
from pagelode.operators.model_output import Model, jobs_of
from pagelode.operators.prune import content
from pagelode.operators.validate import opengraph
from pagelode.streaming.replay import shared_folder

JOBS = "array<struct<title:string,url:string,location:string,employment_type:string,description:string,salary_range:string>>"


def markdown(html: Column) -> Column:
    """A page's content as Markdown, or null: no scripts, menus, headers, footers, sidebars, forms or comments; headings, list items,
    links and paragraphs keep their form. A rule of our own, with no claim to equal another library's output."""
    body = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)<(script|style|noscript|nav|header|footer|aside|form|button)\b[^>]*>.*?</\1\s*>", "")
    body = F.regexp_replace(body, r"\s+", " ")
    for n in range(1, 7):
        body = F.regexp_replace(body, rf"(?i)<h{n}\b[^>]*>", "\n" + "#" * n + " ")
    body = F.regexp_replace(body, r"(?i)<li\b[^>]*>", "\n- ")
    body = F.regexp_replace(body, r"(?i)<a\s[^>]*?href=[\"']([^\"']+)[\"'][^>]*>\s*([^<]*?)\s*</a>", "[$2]($1)")
    body = F.regexp_replace(body, r"(?i)</?(p|div|section|article|main|ul|ol|table|tr|br|h[1-6])\b[^>]*>", "\n")
    lines = F.transform(F.split(F.regexp_replace(body, rules.TAG, ""), "\n"), lambda x: strip(x))
    return or_null(F.array_join(F.filter(lines, lambda x: ~x.rlike("^[-#]*$")), "\n"))


def dense_markdown(html: Column) -> Column:
    """A page's content by the density of its text, as Markdown, or null."""
    return content(html)["markdown"]


def microdata(html: Column) -> Column:
    """Array of (type, properties) of a page's items; a nested item is one of its own. Of equal names the first value counts."""
    return flat(items(html))


def structured_data(html: Column) -> Column:
    """One struct: job_postings (VARIANT of JSON-LD), microdata and opengraph of a page."""
    return F.struct(json_ld_postings(html).alias("job_postings"), microdata(html).alias("microdata"), opengraph(html).alias("opengraph"))


def schema_rows(answer: Column, fields: dict[str, tuple[str, bool]] = rules.POSTING) -> Column:
    """Array of structs of a model's answer ({"items": [...]} or an array); null if it's no such JSON or any item breaks the schema.

    fields: name to (string, double or timestamp; whether required). Numbers and times may stand in strings."""
    def read(x: Column, name: str, kind: str) -> Column:
        if kind == "string":
            return text(get(x, f"$.{name}"))
        return iso_time(text(get(x, f"$.{name}"))) if kind == "timestamp" else get(x, f"$.{name}", kind)

    def good(x: Column) -> Column:
        out = is_object(x)
        for name, (kind, required) in fields.items():
            absent = F.coalesce(kind_of(get(x, f"$.{name}")) == "VOID", F.lit(True))
            out = out & (read(x, name, kind).isNotNull() | (F.lit(False) if required else absent))
        return out

    def rows(v: Column) -> Column:
        found = F.coalesce(get(v, "$.items", "array<variant>"), get(v, "$", "array<variant>"))
        return F.when(F.forall(found, good), F.transform(found, lambda x: F.struct(*(read(x, k, t).alias(k) for k, (t, _) in fields.items()))))

    return let(F.try_parse_json(without_fences(answer)), rows)


def field_list(schema: StructType) -> str:
    """The fields of a schema as lines for a prompt, each with the first sentence of its comment."""
    lines = []
    for f in schema.fields:
        note = (f.metadata or {}).get("comment", "").split(".")[0]
        lines.append(f"  {f.name}: {note}" if note else f"  {f.name}")
    return "\n".join(lines)


def _none() -> Column:
    return F.array().cast(JOBS)


def structured_jobs(html: Column) -> Column:
    """The first tier: postings of the page's JSON-LD that have a title and a URL."""

    def row(x: Column) -> Column:
        place = F.coalesce(text(get(x, "$.jobLocation.address.addressLocality")), text(get(x, "$.jobLocation")))
        part = lambda k: text(get(x, f"$.{k}"))
        return F.struct(
            or_null(part("title")).alias("title"), or_null(part("url")).alias("url"), place.alias("location"), part("employmentType").alias("employment_type"),
            part("description").alias("description"), base_salary(get(x, "$.baseSalary")).alias("salary_range"),
        )

    found = F.filter(F.transform(json_ld_postings(html), row), lambda j: j["title"].isNotNull() & j["url"].isNotNull())
    return F.coalesce(found.cast(JOBS), _none())


def schema_listings(answer: Column) -> Column:
    """The second tier's answer as jobs; none if any item breaks the schema."""

    def row(x: Column) -> Column:
        pay = schema_salary(x["salary_currency"], x["salary_min"], x["salary_max"])
        return F.struct(*(x[k].alias(k) for k in ("title", "url", "location", "employment_type", "description")), pay.alias("salary_range"))

    named = F.filter(schema_rows(answer), lambda x: (x["title"] != "") & (x["url"] != ""))
    return F.coalesce(F.transform(named, row).cast(JOBS), _none())


def hosted_listings(answer: Column) -> Column:
    """The last tier's answer ({"jobs": [...]}) as jobs."""
    keep = ("title", "url", "location", "employment_type", "description", "salary_range")
    return F.coalesce(F.transform(jobs_of(answer), lambda x: F.struct(*(x[k].alias(k) for k in keep))).cast(JOBS), _none())


def asked(model: Model, prompt: Column, limit: int = 4096) -> Column:
    """The model's answers; null prompts aren't asked, cut-off answers are null."""

    @F.pandas_udf("string")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            known = part.notna()
            out = pd.Series([None] * len(part), index=part.index, dtype=object)
            texts = part[known].tolist()
            if texts:
                out[known] = [None if cut else a for a, cut in model(texts, limit)]
            yield out

    return ask(prompt)


def _once(rows: DataFrame) -> DataFrame:
    """rows written to the shared folder: models are asked where this runs, and by no later action."""
    path = f"{shared_folder(rows.sparkSession)}/answers-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def extract(pages: DataFrame, local: Model | None = None, hosted: Model | None = None, html: str = "html", prompt: Callable[[Column], Column] = markdown) -> DataFrame:
    """pages with jobs and tier (0, 2, 4, or null without jobs): the first tier that finds some decides.

    Models are asked once, here: their answers are kept in the shared folder for all later actions.
    prompt: what the local model reads of a page: markdown(), or dense_markdown() where boilerplate bears no tags that say so."""
    ship_package(pages.sparkSession)
    c = F.col
    rows = pages.withColumn("_0", structured_jobs(c(html)))
    empty = F.size("_0") == 0
    rows = _once(rows.withColumn("_2", schema_listings(asked(local, F.when(empty, prompt(c(html))))))) if local else rows.withColumn("_2", _none())
    empty = empty & (F.size("_2") == 0)
    rows = _once(rows.withColumn("_4", hosted_listings(asked(hosted, F.when(empty, or_null(clean_lines(c(html)))))))) if hosted else rows.withColumn("_4", _none())
    tier = F.when(F.size("_0") > 0, 0).when(F.size("_2") > 0, 2).when(F.size("_4") > 0, 4)
    return rows.withColumn("tier", tier).withColumn("jobs", F.when(tier == 0, c("_0")).when(tier == 2, c("_2")).otherwise(c("_4"))).drop("_0", "_2", "_4")
