"""Queries of the provider parsers: payloads are made from the customer table (pages of 50), parsed, and held against the table itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.operators.listings import exploded, listings

PER_PAGE = 50


@dataclass
class Payload:
    url: str  # of the page; {p} is its number
    item: Callable[[], Column]
    content: Callable[[Column], Column]  # of the JSON array of items
    sql: dict[str, str]  # expected columns
    where: str = "true"


def _c(name: str) -> Column:
    return F.col(name)


def _cat(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _named(**fields: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


_DAY = lambda: F.lpad((_c("k") % 28 + 1).cast("string"), 2, "0")
_WHEN = lambda: _cat("2024-01-", _DAY(), "T10:00:00Z")
_BODY = lambda: _cat("<p>About ", _c("name"), "</p><ul><li>One <b>", _c("k").cast("string"), "</b></li><li> </li><li>Two</li></ul>")
_TITLE = lambda: F.when(_c("k") % 7 != 0, _c("seg"))
_ID = lambda: _c("k").cast("string")
_JOB = lambda: _cat("https://x.example/jobs/", _ID())
_TERMS = lambda: F.when(_c("k") % 2 == 0, "Full time").otherwise("Part time")
_S = {"day": "'2024-01-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0')", "body": "'About ' || name || 'One ' || k || ' Two'", "terms": "CASE WHEN k % 2 = 0 THEN 'Full time' ELSE 'Part time' END", "job": "'https://x.example/jobs/' || k"}
_TITLED = "k % 7 <> 0"


def _ld(describe: bool = True) -> Column:
    fields = {
        "@type": F.lit("JobPosting"), "title": _TITLE(), "url": F.when(_c("k") % 4 != 0, _cat("/jobs/", _ID())), "employmentType": _TERMS(),
        "jobLocationType": F.when(_c("k") % 5 == 0, "TELECOMMUTE"), "description": _cat("<p>Hi ", _c("name"), "</p>"),
        "jobLocation": _named(address=_named(addressLocality=_c("nat"), addressCountry=_c("seg"))),
        "baseSalary": _named(currency=F.when(_c("k") % 3 == 0, "USD").otherwise("EUR"), value=_named(minValue=_c("k") * 1000, maxValue=_c("k") * 2000, unitText=F.lit("YEAR"))),
    }
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def _scripts(json: Column) -> Column:
    return _cat('<html><head><script type="application/ld+json">', json, '</script><script type="application/ld+json">not json</script></head></html>')


_LD_SQL = {
    "title": "seg", "location": "CASE WHEN k % 5 = 0 THEN 'Remote' ELSE nat || ', ' || seg END", "employment_type": _S["terms"],
    "salary_range": "CASE WHEN k % 3 = 0 THEN '$' || format('{:,}', k * 1000) || '–$' || format('{:,}', k * 2000) ELSE 'EUR ' || format('{:,}', k * 1000) || '–EUR ' || format('{:,}', k * 2000) END || '/year'",
}


def _ld_url(host: str) -> str:
    return f"CASE WHEN k % 4 <> 0 THEN 'https://{host}/jobs/' || k ELSE page_url END"


def _cards(cls: str) -> Callable[[], Column]:
    return lambda: _named(html=_cat(f'<div class="{cls}"><h3>', F.coalesce(_TITLE(), F.lit(" ")), ' <em>x</em></h3><a href="/p/', _ID(), '">go</a></div>'))


PAYLOADS: dict[str, Payload] = {
    "greenhouse": Payload(
        "https://boards.greenhouse.io/b{p}",
        lambda: _named(id=_c("k"), title=_TITLE(), absolute_url=_JOB(), location=_named(name=_c("nat")), content=_BODY(), updated_at=_WHEN(),
                       departments=F.array(_named(name=F.lit("Root"), child_ids=F.array(F.lit(1))), _named(name=_c("seg"), child_ids=F.array().cast("array<int>"))),
                       pay_input_ranges=F.array(_named(min_cents=_c("k") * 10000, max_cents=F.when(_c("k") % 3 != 0, _c("k") * 20000), currency_type=F.lit("USD")))),
        lambda j: _cat('{"jobs":', j, "}"),
        {"title": "seg", "url": _S["job"], "location": "nat", "department": "seg", "description": _S["body"], "requirements": "'One ' || k || '|Two'", "posted": _S["day"],
         "salary_range": "CASE WHEN k % 3 = 0 THEN 'USD ' || format('{:,}', k * 100) || '+' ELSE 'USD ' || format('{:,}', k * 100) || ' - ' || format('{:,}', k * 200) END"},
        _TITLED,
    ),
    "lever": Payload(
        "https://jobs.lever.co/b{p}",
        lambda: _named(id=_ID(), text=_TITLE(), hostedUrl=F.when(_c("k") % 5 != 0, _JOB()), createdAt=F.lit(1_700_000_000_000) + _c("k") * 86_400_000,
                       categories=_named(location=_c("nat"), department=_c("seg"), commitment=_TERMS()), lists=F.array(_named(text=F.lit("Need"), content=_BODY())), descriptionPlain=_c("name"),
                       salaryRange=_named(currency=F.lit("EUR"), interval=F.lit("per-year"), min=_c("k") * 1000, max=_c("k") * 2000)),
        lambda j: j,
        {"title": "coalesce(CASE WHEN k % 7 <> 0 THEN seg END, 'Untitled Position')", "url": f"CASE WHEN k % 5 <> 0 THEN {_S['job']} ELSE 'https://jobs.lever.co/unknown/' || k END", "location": "nat",
         "department": "seg", "employment_type": _S["terms"], "description": "name", "requirements": "'One ' || k || '|Two'", "posted": "strftime(make_timestamp((1700000000 + k * 86400) * 1000000), '%Y-%m-%d')",
         "salary_range": "'EUR ' || format('{:,}', k * 1000) || ' - ' || format('{:,}', k * 2000) || ' per-year'"},
    ),
    "ashby": Payload(
        "https://jobs.ashbyhq.com/b{p}",
        lambda: _named(id=_ID(), title=_TITLE(), jobUrl=F.when(_c("k") % 5 != 0, _JOB()), locationName=F.when(_c("k") % 6 != 0, _c("nat")), isRemote=_c("k") % 4 == 0, departmentName=_c("seg"), employmentType=_TERMS(),
                       descriptionHtml=_BODY(), publishedDate=_WHEN(), compensationTierSummary=F.when(_c("k") % 3 == 0, "A - B")),
        lambda j: _cat('{"data":{"jobBoard":{"jobPostings":', j, "}}}"),
        {"title": "seg", "url": f"CASE WHEN k % 5 <> 0 THEN {_S['job']} ELSE 'https://jobs.ashbyhq.com/unknown/' || k END",
         "location": "CASE WHEN k % 4 = 0 THEN CASE WHEN k % 6 <> 0 THEN nat || ' (Remote)' ELSE 'Remote' END WHEN k % 6 <> 0 THEN nat END", "department": "seg", "employment_type": _S["terms"],
         "description": _S["body"], "requirements": "'One ' || k || '|Two'", "posted": _S["day"], "salary_range": "CASE WHEN k % 3 = 0 THEN 'A - B' END"},
        _TITLED,
    ),
    "smartrecruiters": Payload(
        "https://jobs.smartrecruiters.com/b{p}",
        lambda: _named(id=_ID(), name=_TITLE(), company=_named(identifier=F.when(_c("k") % 3 != 0, _c("name"))), location=_named(fullLocation=F.when(_c("k") % 2 == 0, _c("nat")), city=_c("seg")),
                       department=_named(label=_c("seg")), typeOfEmployment=_named(label=_TERMS()), releasedDate=_WHEN()),
        lambda j: _cat('{"content":', j, "}"),
        {"title": "seg", "url": "CASE WHEN k % 3 <> 0 THEN 'https://jobs.smartrecruiters.com/' || name || '/' || k ELSE page_url || '/' || k END", "location": "CASE WHEN k % 2 = 0 THEN nat ELSE seg END",
         "department": "seg", "employment_type": _S["terms"], "posted": _S["day"]},
        _TITLED,
    ),
    "workday": Payload(
        "https://w.myworkdayjobs.com/b{p}", _ld, _scripts,
        _LD_SQL | {"url": _ld_url("w.myworkdayjobs.com"), "description": "'>Hi ' || name || '>'"}, _TITLED,
    ),
    "icims": Payload(
        "https://c.icims.com/b{p}",
        lambda: _named(jobtitle=_TITLE(), applyurl=F.when(_c("k") % 4 != 0, _cat("/apply/", _ID())), joblocation=_c("nat"), id=_c("k")),
        lambda j: _cat('{"searchResults":', j, ',"totalCount":1}'),
        {"title": "seg", "url": "CASE WHEN k % 4 <> 0 THEN 'https://c.icims.com/apply/' || k ELSE 'https://c.icims.com/jobs/' || k || '/job' END", "location": "nat"}, _TITLED,
    ),
    "rippling": Payload(
        "https://ats.rippling.com/b{p}",
        lambda: _named(id=_ID(), name=_TITLE(), url=F.when(_c("k") % 4 != 0, _JOB()), department=_named(name=_c("seg")), employmentType=_TERMS(),
                       locations=F.array(_named(name=F.when(_c("k") % 6 != 0, _c("nat")), workplaceType=F.when(_c("k") % 5 == 0, "REMOTE").otherwise("ONSITE")))),
        lambda j: _cat('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"jobs":{"items":', j, "}}}}</script>"),
        {"title": "seg", "url": f"CASE WHEN k % 4 <> 0 THEN {_S['job']} ELSE 'https://ats.rippling.com/unknown/jobs/' || k END", "department": "seg", "employment_type": _S["terms"],
         "location": "CASE WHEN k % 5 = 0 THEN CASE WHEN k % 6 <> 0 THEN nat || ' (Remote)' ELSE 'Remote' END WHEN k % 6 <> 0 THEN nat END"}, _TITLED,
    ),
    "teamtailor": Payload(
        "https://b{p}.teamtailor.com/jobs",
        lambda: F.struct(_ID().alias("id"), F.struct(_TITLE().alias("title"), _c("nat").alias("location"), _TERMS().alias("employment-type"), _BODY().alias("body"), _WHEN().alias("created-at")).alias("attributes"),
                         F.struct(F.when(_c("k") % 4 != 0, _JOB()).alias("careersite-job-url")).alias("links")),
        lambda j: _cat('{"data":', j, "}"),
        {"title": "seg", "url": f"CASE WHEN k % 4 <> 0 THEN {_S['job']} ELSE page_url END", "location": "nat", "employment_type": _S["terms"], "description": _S["body"], "posted": _S["day"]}, _TITLED,
    ),
    "recruitee": Payload(
        "https://b{p}.recruitee.com/",
        lambda: _named(id=_c("k"), title=_TITLE(), slug=_cat("s-", _ID()), careers_url=F.when(_c("k") % 4 != 0, _JOB()), city=_c("nat"), department=_c("seg"), employment_type_code=_TERMS(), description=_BODY(), created_at=_WHEN()),
        lambda j: _cat('{"offers":', j, "}"),
        {"title": "seg", "url": f"CASE WHEN k % 4 <> 0 THEN {_S['job']} ELSE 'https://b' || p || '.recruitee.com/o/s-' || k END", "location": "nat", "department": "seg", "employment_type": _S["terms"], "description": _S["body"], "posted": _S["day"]}, _TITLED,
    ),
    "pinpoint": Payload(
        "https://b{p}.pinpointhq.com/jobs",
        lambda: _named(id=_c("k"), title=_TITLE(), absolute_url=F.when(_c("k") % 4 != 0, _JOB()), location=_c("nat"), team=_c("seg"), job_type=_TERMS(), description=_BODY(), published_at=_WHEN()),
        lambda j: _cat('{"jobs":', j, "}"),
        {"title": "seg", "url": f"CASE WHEN k % 4 <> 0 THEN {_S['job']} ELSE page_url END", "location": "nat", "department": "seg", "employment_type": _S["terms"], "description": _S["body"], "posted": _S["day"]}, _TITLED,
    ),
    "breezy": Payload(
        "https://b{p}.breezy.hr/",
        lambda: _named(_id=_ID(), name=_TITLE(), friendly_id=F.when(_c("k") % 4 != 0, _cat("f-", _ID())), location=_named(city=_c("nat")), department=_named(name=_c("seg")), type=_TERMS(), description=_BODY(),
                       creation_date=F.lit(1_700_000_000_000) + _c("k") * 86_400_000),
        lambda j: j,
        {"title": "seg", "url": "'https://b' || p || '.breezy.hr/p/' || CASE WHEN k % 4 <> 0 THEN 'f-' || k ELSE CAST(k AS VARCHAR) END", "location": "nat", "department": "seg", "employment_type": _S["terms"], "description": _S["body"],
         "posted": "strftime(make_timestamp((1700000000 + k * 86400) * 1000000), '%Y-%m-%d')"}, _TITLED,
    ),
    "phenom": Payload(
        "https://careers.phenom.com/b{p}", _cards("x ph-job-card"), lambda j: F.array_join(F.from_json(j, "array<struct<html:string>>")["html"], "\n"),
        {"title": "seg || ' x'", "url": "'https://careers.phenom.com/p/' || k"}, "true",
    ),
    "eightfold": Payload(
        "https://c.eightfold.ai/b{p}",
        lambda: F.struct(F.lit("JobPosting").alias("@type"), _TITLE().alias("title"), _JOB().alias("url"), _c("seg").alias("occupationalCategory"), _TERMS().alias("employmentType"), _named(address=_named(addressLocality=_c("nat"))).alias("jobLocation")),
        _scripts, {"title": "seg", "url": _S["job"], "location": "nat", "department": "seg", "employment_type": _S["terms"]}, _TITLED,
    ),
    "sap_successfactors": Payload(
        "https://c.successfactors.com/b{p}",
        lambda: _named(jobReqId=_ID(), jobTitle=_TITLE(), applyUrl=F.when(_c("k") % 4 != 0, _JOB()), location=_c("nat"), department=_c("seg"), employmentType=_TERMS(), jobDescription=_BODY(),
                       postingDate=F.when(_c("k") % 2 == 0, _cat("/Date(", (F.lit(1_700_000_000_000) + _c("k") * 86_400_000).cast("string"), "+0000)/")).otherwise(_WHEN())),
        lambda j: _cat('{"d":{"results":', j, "}}"),
        {"title": "seg", "url": f"CASE WHEN k % 4 <> 0 THEN {_S['job']} ELSE 'https://c.successfactors.com/job/' || k END", "location": "nat", "department": "seg", "employment_type": _S["terms"], "description": _S["body"],
         "posted": f"CASE WHEN k % 2 = 0 THEN strftime(make_timestamp((1700000000 + k * 86400) * 1000000), '%Y-%m-%d') ELSE {_S['day']} END"}, _TITLED,
    ),
}


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), F.trim("n_name").alias("nat"))
    return c.join(n, "c_nationkey").select(
        F.col("c_custkey").alias("k"), F.floor(F.col("c_custkey") / PER_PAGE).alias("p"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), "nat"
    )


CUSTOMERS_SQL = f"SELECT c_custkey AS k, c_custkey // {PER_PAGE} AS p, c_name AS name, c_mktsegment AS seg, trim(n_name) AS nat FROM customer JOIN nation ON c_nationkey = n_nationkey"


def payload_pages(spark: SparkSession, sf_dir: str, provider: str) -> DataFrame:
    """url and content of pages in a provider's format, of PER_PAGE customers each."""
    made = PAYLOADS[provider]
    base = customers(spark, sf_dir).withColumn("item", made.item())
    pages = base.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("k", "item")), lambda a, b: (a["k"] - b["k"]).cast("int")).alias("items"))
    json = F.to_json(F.transform("items", lambda x: x["item"]))
    return pages.select(F.replace(F.lit(made.url), F.lit("{p}"), F.col("p").cast("string")).alias("url"), made.content(json).alias("content"))


def parse_query(provider: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = exploded(listings(payload_pages(spark, sf_dir, provider), provider))
        return found.select(
            "page_url", "pos", "title", "url", "location", "department", "employment_type", "description", F.array_join("requirements", "|").alias("requirements"), "salary_range",
            F.date_format("posted_date", "yyyy-MM-dd").alias("posted"), "ats_provider",
        )

    run.__name__ = f"parse_{provider}"
    return run


def parse_oracle(provider: str) -> str:
    made = PAYLOADS[provider]
    a, b = made.url.split("{p}")
    columns = {"location": "NULL", "department": "NULL", "employment_type": "NULL", "description": "NULL", "requirements": "''", "salary_range": "NULL", "posted": "NULL"} | made.sql
    # Without a title the job cards hold only the mark in their heading.
    if provider == "phenom":
        columns["title"] = "CASE WHEN k % 7 <> 0 THEN seg || ' x' ELSE 'x' END"
    listed = ", ".join(f"CAST({v} AS VARCHAR) AS {k}" for k, v in columns.items())
    return (
        f"WITH c AS ({CUSTOMERS_SQL}), d AS (SELECT *, '{a}' || p || '{b}' AS page_url FROM c WHERE {made.where}) "
        f"SELECT page_url, CAST(row_number() OVER (PARTITION BY p ORDER BY k) - 1 AS INTEGER) AS pos, {listed}, '{provider}' AS ats_provider FROM d"
    )
