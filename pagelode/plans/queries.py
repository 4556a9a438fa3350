"""The engine's queries and, where SQL can say the same over the same tables, their SQL.

The driver's pages carry no provider or validator signals, so queries of those operators put signals into the pages by page_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import text, urls
from pagelode.operators import audit, detect, incremental, listings, model_output, scrape, validate
from pagelode.plans.payloads import CUSTOMERS_SQL, PAYLOADS, customers, parse_oracle, parse_query, payload_pages
from pagelode.plans import history_queries, page_queries, sql_queries, stream_queries, tier_queries  # noqa: F401 (they register their queries)
from pagelode.plans.registry import ORACLES, QUERIES, query
from pagelode.sources import fetches, sitemaps

QUERIES |= {f"parse_{p}": parse_query(p) for p in PAYLOADS}
ORACLES |= {f"parse_{p}": parse_oracle(p) for p in PAYLOADS}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetches.read_pages(spark, f"{sf_dir}/pages.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and so on as parse events: an error is a salvaged parse."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    status = F.when(F.col("event_type") == "error", "salvaged").when(F.col("event_type") == "signup", "truncated").when(F.col("event_type") == "view", "failed").otherwise("clean")
    return e.select("event_id", F.concat(F.lit("s"), F.col("user_id") % 20).alias("source"), F.lit("m").alias("model"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))


_EVENTS = """e AS (SELECT event_id, 's' || (user_id % 20) AS source, 'm' AS model, CAST(ts AS TIMESTAMP) AS ts,
 CASE event_type WHEN 'error' THEN 'salvaged' WHEN 'signup' THEN 'truncated' WHEN 'view' THEN 'failed' ELSE 'clean' END AS status FROM events)"""


# Text and keys


@query(r"SELECT page_id, sha256(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS content_hash FROM pages")
def content_hash(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.content_hash(F.col("html")).alias("content_hash"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'id:' || page_id WHEN page_id % 4 = 1 THEN 'url:' || url WHEN page_id % 4 = 2 THEN 'title:' || left(sha256(url), 16)
 WHEN page_id % 8 = 3 THEN 'content:' || left(sha256(html), 16) ELSE 'unknown' END AS key FROM pages""")
def stable_listing_key(spark, sf_dir):
    k = F.col("page_id") % 4
    key = text.stable_key(
        F.when(k == 0, F.col("page_id").cast("string")), F.when(k == 1, F.col("url")).otherwise(""), F.when(k == 2, F.col("url")), F.when(F.col("page_id") % 8 == 3, F.col("html"))
    )
    return _pages(spark, sf_dir).select("page_id", key.alias("key"))


@query(r"""SELECT page_id, CAST(length(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')) AS INTEGER) AS plain,
 CAST(length(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS INTEGER) AS spaced,
 CAST(length(regexp_replace(regexp_replace(html, '<[^>]+', '', 'g'), '^\s+|\s+$', '', 'g')) AS INTEGER) AS lossy FROM pages""")
def strip_html_length(spark, sf_dir):
    h = F.col("html")
    return _pages(spark, sf_dir).select(
        "page_id", F.char_length(text.strip_tags(h)).alias("plain"), F.char_length(text.strip_tags(h, " ")).alias("spaced"), F.char_length(text.strip_tags(h, pattern=r"<[^>]+")).alias("lossy")
    )


@query(r"""WITH i AS (SELECT page_id, unnest(list_filter(list_transform(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1), lambda x: regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS item,
 generate_subscripts(list_filter(list_transform(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1), lambda x: regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), 1) AS n FROM pages)
SELECT page_id, CAST(n - 1 AS INTEGER) AS pos, item FROM i""")
def extract_list_items(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.posexplode(text.list_items(F.col("html"))).alias("pos", "item"))


@query(r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) AS href,
 generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1), 1) AS n FROM pages)
SELECT page_id, CAST(n - 1 AS INTEGER) AS pos, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS target FROM l""")
def extract_links(spark, sf_dir):
    found = _pages(spark, sf_dir).select("page_id", "url", F.posexplode(text.links(F.col("html"))).alias("pos", "href"))
    return found.select("page_id", "pos", urls.join(F.col("url"), F.col("href")).alias("target"))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', '', 'g') AS h FROM pages),
l AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<a\s[^>]*href=["'']([^"'']+)["''][^>]*>([^<]*)</a>', '\2 (\1)', 'g'), '<[^>]+>', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g') AS t FROM b)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS cleaned FROM l""")
def clean_text_lines(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.clean_lines(F.col("html")).alias("cleaned"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
c AS (SELECT doc_id, n, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS upto FROM l),
r AS (SELECT doc_id, -1 AS pos, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS done, CAST(0 AS BIGINT) AS base FROM documents UNION ALL
 SELECT r.doc_id, r.pos + 1, r.done + 1, max(c.n), max(c.upto) FROM r JOIN c ON r.doc_id = c.doc_id AND c.n > r.done AND (c.n = r.done + 1 OR c.upto - 1 - r.base <= 2000) GROUP BY r.doc_id, r.pos, r.done)
SELECT r.doc_id, r.pos, string_agg(c.line, chr(10) ORDER BY c.n) AS chunk FROM r JOIN c ON r.doc_id = c.doc_id AND c.n BETWEEN r.first AND r.done WHERE r.pos >= 0 GROUP BY r.doc_id, r.pos""")
def chunk_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(text.chunk_lines(F.coalesce("text", F.lit("")), 2000)).alias("pos", "chunk"))


# Detection and validation: signals by page_id

_PROVIDERS = list(PAYLOADS)
_URLS = {p: v.url.replace("{p}", "7") for p, v in PAYLOADS.items()} | {"unknown": "https://example.com/about"}
_NAMES = [*_URLS]


def _case(values: list[str], on: str) -> str:
    return f"CASE {on} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_API = {"greenhouse": "https://boards-api.greenhouse.io/v1/boards/b7/jobs?content=true", "lever": "https://api.lever.co/v0/postings/b7?mode=json", "smartrecruiters": "https://api.smartrecruiters.com/v1/companies/b7/postings"}


@query(f"SELECT c_custkey AS k, {_case(_NAMES, 'c_custkey')} AS provider, nullif({_case([_API.get(n, '') for n in _NAMES], 'c_custkey')}, '') AS api_url FROM customer")
def detect_url(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    url = F.get(F.array(*(F.lit(_URLS[n]) for n in _NAMES)), (F.col("c_custkey") % len(_NAMES)).cast("int"))
    rows = c.select(F.col("c_custkey").alias("k"), url.alias("url")).withColumn("provider", detect.provider_of_url(F.col("url")))
    return rows.select("k", "provider", urls.api_url(F.col("url"), F.col("provider")).alias("api_url"))


_DOM = [("greenhouse", "<div id='greenhouse_app'>", 0.85), ("workday", "<p>Workday</p>", 0.7), ("lever", "<p>workday</p><div class='lever-jobs-container'>", 0.85), ("ashby", "<i>ashbyhq.com</i>", 0.8), ("icims", "<i class='iCIMS_x'>", 0.75), ("phenom", "<i class='a phw-b'>", 0.85), ("unknown", "<i>", 0.0)]


@query(f"SELECT page_id, {_case([d[0] for d in _DOM], 'page_id')} AS provider, CAST({_case([str(d[2]) for d in _DOM], 'page_id')} AS DOUBLE) AS confidence, CASE WHEN page_id % {len(_DOM)} <> {len(_DOM) - 1} THEN 'dom_signature' END AS detection_method FROM pages")
def detect_dom(spark, sf_dir):
    mark = F.get(F.array(*(F.lit(d[1]) for d in _DOM)), (F.col("page_id") % len(_DOM)).cast("int"))
    rows = detect.with_detection(_pages(spark, sf_dir).withColumn("html", F.concat(mark, "html")))
    return rows.select("page_id", "provider", "confidence", "detection_method")


_SIGNALS = [
    ("", '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting"}]}</script>', "schema_job_posting", True, 0.95),
    ("", '<script type="application/ld+json">[{"@type":["Thing","NewsArticle"]}]</script>', "schema_non_job", False, 0.9),
    ("", '<meta property="og:type" content="article"><meta property="article:published_time" content="x">', "og_article", False, 0.85),
    ("", '<meta name="robots" content="noindex">', "noindex_meta", False, 0.9),
    ("", '<link rel="canonical" href="https://x.example/blog/1">', "canonical_non_job", False, 0.9),
    ("", '<div class="lever-jobs-container"></div>', "ats_detected", True, 0.9),
    ("/careers", "<h1>Careers</h1>", "url_pattern+title_match", True, 0.65),
    ("/jobs", "", "url_pattern", True, 0.5),
    ("", "<h1>Join us</h1>", "title_match", True, 0.4),
    ("", "", "no_signals", False, 0.55),
    ("/jobs", None, "empty_page", True, 0.4),
    ("", None, "empty_page", False, 0.75),
]


def _signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("page_id") % len(_SIGNALS)).cast("int")
    mark = F.get(F.array(*(F.lit(s[1]) for s in _SIGNALS)), at)
    path = F.get(F.array(*(F.lit(s[0]) for s in _SIGNALS)), at)
    url = F.concat(F.lit("https://example.com"), path, F.lit("/x"), F.col("page_id"))
    return _pages(spark, sf_dir).select("page_id", url.alias("url"), F.when(mark.isNull(), "<p>short</p>").otherwise(F.concat(mark, "html")).alias("html"))


_VALID_SQL = f"""SELECT page_id, {_case([s[2] for s in _SIGNALS], 'page_id')} AS reason_code, CAST({_case([str(s[3]).lower() for s in _SIGNALS], 'page_id')} AS BOOLEAN) AS is_valid,
 CAST({_case([str(s[4]) for s in _SIGNALS], 'page_id')} AS DOUBLE) AS verdict_confidence, page_id % {len(_SIGNALS)} >= 10 AS suspect FROM pages"""


_SEEN = [
    "schema_job_posting", "schema_non_job:NewsArticle", "og_article+published_time", "noindex_meta", "canonical_non_job:https://x.example/blog/1", "ats_detected:lever",
    "url_pattern|title_match", "url_pattern", "title_match", "", "url_pattern|empty_or_sparse", "empty_or_sparse",
]
_LISTS = "job[-_]?card|job[-_]?listing|position[-_]?item|role[-_]?item|opening[-_]?row|data-job-id|class=[\"'']job|class=[\"'']position|class=[\"'']role|aria-label=[\"'']job\\s+posting"


@query(f"""SELECT v.*, array_to_string(list_filter([{_case(_SEEN, 'page_id')}, CASE WHEN page_id % 12 >= 10 OR page_id % 12 >= 6 AND NOT regexp_matches(html, '(?i)({_LISTS})') THEN 'no_job_list_signals' ELSE '' END],
 lambda x: x <> ''), '|') AS signals FROM ({_VALID_SQL}) v JOIN (SELECT page_id, html FROM pages) USING (page_id)""")
def validate_pages(spark, sf_dir):
    rows = validate.with_validation(detect.with_detection(_signalled(spark, sf_dir)))
    return rows.select("page_id", "reason_code", "is_valid", "verdict_confidence", "suspect", F.array_join("signals", "|").alias("signals"))


@query(f"WITH v AS ({_VALID_SQL}) SELECT reason_code, count(*) AS pages, CAST(sum(CASE WHEN is_valid THEN 0 ELSE 1 END) AS BIGINT) AS rejected, count(*) / sum(count(*)) OVER () AS share FROM v GROUP BY reason_code")
def reject_rate(spark, sf_dir):
    return audit.reject_rates(validate_pages(spark, sf_dir))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http_403' WHEN 1 THEN 'cloudflare_challenge_body' WHEN 2 THEN 'cloudflare_challenge_body' END AS challenge,
 CASE page_id % 5 WHEN 0 THEN 'TIER3_403' WHEN 2 THEN 'TIER3_CLOUDFLARE' WHEN 3 THEN 'TIER3_EMPTY_200' END AS browser FROM pages""")
def escalation_reason(spark, sf_dir):
    k = F.col("page_id") % 5
    body = F.when(k == 1, F.concat(F.lit("<p>Just a moment</p>"), "html")).when(k == 2, F.concat(F.lit("<p>Cloudflare: checking your browser</p>"), "html")).when(k == 3, "<p>x</p>").otherwise(F.col("html"))
    rows = _pages(spark, sf_dir).select("page_id", F.when(k == 0, 403).otherwise(200).alias("status"), body.alias("body"))
    return rows.select("page_id", detect.challenge_reason(F.col("status"), F.col("body")).alias("challenge"), detect.browser_reason(F.col("status"), F.col("body")).alias("browser"))


@query("""WITH c AS (SELECT c_custkey AS k FROM customer), u AS (
 SELECT k, 'https://x.example/p' AS url, 1 AS rank, 0.0 AS score FROM c UNION ALL
 SELECT k, 'https://acme.example/careers/' || k, 2, 0.5 FROM c WHERE k % 2 = 0 UNION ALL SELECT k, 'https://w.icims.com/' || k, 3, 0.85 FROM c WHERE k % 3 = 0 UNION ALL SELECT k, 'https://jobs.lever.co/' || k, 4, 1.0 FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank) AS n FROM u)
SELECT k, arg_max(url, score) AS url, CAST(max(score) AS DOUBLE) AS score FROM r WHERE n <= 3 GROUP BY k HAVING max(score) >= 0.5""")
def url_score_best(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    every = F.array_compact(F.array(
        F.struct(F.lit("https://x.example/p").alias("url"), F.lit(1).alias("rank")),
        F.when(F.col("k") % 2 == 0, F.struct(F.concat(F.lit("https://acme.example/careers/"), F.col("k")).alias("url"), F.lit(2).alias("rank"))),
        F.when(F.col("k") % 3 == 0, F.struct(F.concat(F.lit("https://w.icims.com/"), F.col("k")).alias("url"), F.lit(3).alias("rank"))),
        F.struct(F.concat(F.lit("https://jobs.lever.co/"), F.col("k")).alias("url"), F.lit(4).alias("rank")),
    ))
    return detect.best_candidates(c.select("k", F.inline(every)), "k")


@query("SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_extract(url, '://[^/?#]*(.*)$', 1) AS normal FROM pages")
def normal_url(spark, sf_dir):
    shouted = F.regexp_replace(F.concat(F.upper(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)), F.when(F.col("url").startswith("https"), ":443").otherwise(":80"), F.regexp_extract("url", "://[^/?#]*(.*)$", 1)), "^$", "")
    return _pages(spark, sf_dir).select("page_id", urls.normal(shouted).alias("normal"))


# Listings


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 2 THEN 0 ELSE 1 END AS n, CASE c_custkey % 3 WHEN 0 THEN 'ld' WHEN 1 THEN 'blob' END AS title FROM customer")
def parser_fallback_order(spark, sf_dir):
    """Structured data wins over the page's own JSON, which is asked only without it."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    ld = F.when(F.col("k") % 3 == 0, '<script type="application/ld+json">{"@type":"JobPosting","title":"ld"}</script>').otherwise("")
    blob = F.when(F.col("k") % 3 != 2, '<script>x={"jobPostings":[{"title":"blob","externalUrl":"/j/1"}]}</script>').otherwise("")
    rows = listings.listings(c.select("k", F.lit("https://a.myworkdayjobs.com/x").alias("url"), F.concat(ld, blob).alias("content")), "workday")
    return rows.select("k", F.size("jobs").alias("n"), F.get(F.col("jobs"), F.lit(0))["title"].alias("title"))


_LD_ITEM = '{"@type":"JobPosting","title":"%s","url":"https://j.example/%d","jobLocation":{"address":{"addressLocality":"%s"}},"description":"<p>d</p>"}'


@query(f"WITH c AS ({CUSTOMERS_SQL}) SELECT k, seg AS title, 'https://j.example/' || k AS url, nat AS location, 'd' AS description FROM c WHERE k % 4 <> 0")
def jsonld_jobs(spark, sf_dir):
    named = F.when(F.col("k") % 4 != 0, F.format_string(_LD_ITEM, "seg", "k", "nat")).otherwise('{"@type":"Person"}')
    html = F.concat(F.lit('<script type="application/ld+json">['), named, F.lit("]</script>"))
    rows = customers(spark, sf_dir).select("k", F.inline(listings.tier0_rows(html, F.lit("https://p.example/"))))
    return rows.select("k", "title", "url", "location", "description")


@query("""WITH o AS (SELECT o_custkey AS page, 'https://j.example/' || (o_orderkey % 5) AS url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT 'https://c.example/' || page AS page_url, url, CAST(min(pos) AS INTEGER) AS pos FROM o GROUP BY page, url""")
def dedup_first_url(spark, sf_dir):
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = o.select(F.concat(F.lit("https://c.example/"), "o_custkey").alias("page_url"), F.concat(F.lit("https://j.example/"), F.col("o_orderkey") % 5).alias("url"), pos.alias("pos"))
    return listings.dedup_first(rows)


@query("SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'salvaged' ELSE 'failed' END AS parse_status, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE c_name END AS title FROM customer")
def model_answers(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    body = F.format_string('{"jobs":[{"title":"%s","url":"https://j.example/%d"}', "c_name", "c_custkey")
    answer = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("]}\n```"))).when(F.col("c_custkey") % 3 == 1, F.concat(body, F.lit(",]"))).otherwise("no jobs")
    rows = model_output.with_decoded(c.select(F.col("c_custkey").alias("k"), answer.alias("answer")))
    return rows.select("k", "parse_status", F.get(F.col("jobs"), F.lit(0))["title"].alias("title"))


# Batches, change and scrape outcome

_BATCH = "i AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 4 = 0 THEN 'https://example.com/p' || (c_custkey % 100) ELSE 'https://boards.greenhouse.io/b' || (c_custkey % 37) || '/jobs/' || c_custkey END AS url FROM customer)"
_KEYED = f"{_BATCH}, k AS (SELECT *, CASE WHEN url LIKE '%greenhouse%' THEN 'greenhouse|https://boards-api.greenhouse.io/v1/boards/' || regexp_extract(url, 'io/([^/]+)', 1) || '/jobs?content=true' ELSE 'url|' || url END AS group_key FROM i)"


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://example.com/p"), k % 100)).otherwise(F.concat(F.lit("https://boards.greenhouse.io/b"), k % 37, F.lit("/jobs/"), k))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("ord"), url.alias("url"))


@query(f"WITH {_KEYED} SELECT ord, url, group_key, first_value(url) OVER (PARTITION BY group_key ORDER BY ord) AS representative, count(*) OVER (PARTITION BY group_key) AS members FROM k")
def batch_coalesce(spark, sf_dir):
    return scrape.batch_groups(_inputs(spark, sf_dir)).select("ord", "url", "group_key", "representative", "members")


@query(f"WITH {_KEYED} SELECT count(*) AS urls, count(DISTINCT group_key) AS groups, count(*) - count(DISTINCT group_key) AS saved FROM k")
def batch_saved_fetches(spark, sf_dir):
    return scrape.saved_fetches(scrape.batch_groups(_inputs(spark, sf_dir)))


@query(r"""WITH n AS (SELECT page_id, 'u' || page_id AS url, html || CASE WHEN page_id % 3 = 0 THEN ' new' ELSE '' END AS now FROM pages)
SELECT n.url, sha256(trim(regexp_replace(now, '\s+', ' ', 'g'))) AS content_hash, page_id % 3 = 0 OR page_id % 5 = 0 AS changed FROM n""")
def change_detection(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("url", F.concat(F.lit("u"), "page_id"))
    old = pages.where("page_id % 5 <> 0").select("url", text.content_hash(F.col("html")).alias("content_hash"))
    return incremental.changes(pages.withColumn("html", F.concat("html", F.when(F.col("page_id") % 3 == 0, " new").otherwise(""))), old)


@query("SELECT o_orderkey AS k, 'https://s.example/' || o_orderkey AS url, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS lastmod FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0")
def lastmod_filter(spark, sf_dir):
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), F.concat(F.lit("https://s.example/"), k).alias("url"), F.when(k % 7 != 0, day).alias("lastmod"), day.alias("day"))
    state = o.where("k % 5 <> 0").select("url", F.when(F.col("k") % 3 == 0, "1970-01-01").otherwise(F.col("day")).alias("lastmod"))
    return incremental.to_fetch(o.select("k", "url", "lastmod"), state)


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'robots' WHEN 1 THEN 'not_modified' WHEN 2 THEN 'rejected' WHEN 3 THEN 'fetch_failed' ELSE 'success' END AS "exit",
 CASE page_id % 6 WHEN 0 THEN 'Blocked by robots.txt' WHEN 2 THEN 'Page rejected by validator [no_signals]' WHEN 3 THEN 'HTTP 500' END AS error, page_id % 6 NOT IN (0, 3) AS fetch_ok,
 CASE WHEN page_id % 6 >= 4 THEN page_id % 6 = 4 WHEN page_id % 6 = 1 THEN false END AS changed, CASE WHEN page_id % 6 = 4 THEN 1 ELSE 0 END AS jobs FROM pages""")
def scrape_outcome(spark, sf_dir):
    k = F.col("page_id") % 6
    pages = _pages(spark, sf_dir)
    url = F.concat(F.when(k == 3, "https://jobs.lever.co/x/").when(k == 4, "https://boards.greenhouse.io/b/").otherwise("https://example.com/"), F.when(k == 5, "jobs/").otherwise(""), "page_id")
    api = F.format_string('{"jobs":[{"title":"T","absolute_url":"https://j.example/%d"}]}', "page_id")
    rows = pages.select(
        url.alias("url"), F.when(k == 1, 304).when(k == 3, 500).otherwise(200).alias("status_code"), F.col("html").alias("content"), (k != 0).alias("robots_allowed"), F.when(k == 4, api).alias("api_content"), "page_id",
    )
    old = rows.where(F.col("page_id") % 6 == 5).select("url", text.content_hash(F.col("content")).alias("content_hash"))
    out = scrape.scrape(rows, old, only=["greenhouse", "lever"]).join(rows.select("url", "page_id"), "url")
    return out.select("page_id", "exit", "error", "fetch_ok", "changed", F.size("jobs").alias("jobs"))


@query("SELECT c_custkey AS ord, 'https://h' || (c_custkey % 11) || '.example/' || c_custkey AS url, 'h' || (c_custkey % 11) || '.example' AS host, CAST((row_number() OVER (PARTITION BY c_custkey % 11 ORDER BY c_custkey) - 1) * 2 AS DOUBLE) AS start_s FROM customer")
def rate_limit_schedule(spark, sf_dir):
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("ord"), F.concat(F.lit("https://h"), k % 11, F.lit(".example/"), k).alias("url"))
    return scrape.rate_schedule(rows.withColumn("host", urls.netloc(F.col("url"))))


# Sites


def _urlsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sitemap for each hundred orders, of a site each; malformed for every ninth."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(F.col("o_orderkey") / 100).alias("s"), F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    entry = F.concat(F.lit("<url><loc> https://s.example/"), "k", F.lit("?a=1&amp;b=2</loc>"), F.when(F.col("k") % 3 != 0, F.concat(F.lit("<lastmod>"), "d", F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))
    body = o.withColumn("e", F.struct("k", entry.alias("x"))).groupBy("s").agg(F.array_sort(F.collect_list("e"))["x"].alias("x"))
    return body.select("s", F.concat(F.lit("<urlset>"), F.array_join("x", ""), F.when(F.col("s") % 9 == 0, "<broken").otherwise("</urlset>")).alias("xml"))


@query("SELECT o_orderkey // 100 AS s, 'https://s.example/' || o_orderkey || '?a=1&b=2' AS loc, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS lastmod FROM orders WHERE (o_orderkey // 100) % 9 <> 0")
def sitemap_entries(spark, sf_dir):
    return _urlsets(spark, sf_dir).select("s", F.inline(sitemaps.sitemap_entries(F.col("xml")))).select("s", "loc", "lastmod")


@query("SELECT 's' || (o_orderkey // 100 // 10) || '.example' AS site, 'https://s.example/' || o_orderkey || '?a=1&b=2' AS loc FROM orders WHERE (o_orderkey // 100) % 9 <> 0")
def sitemap_recursive(spark, sf_dir):
    """Sites of ten sitemaps each, named by an index at the second well-known path."""
    sets = _urlsets(spark, sf_dir).withColumn("site", F.concat(F.lit("s"), F.floor(F.col("s") / 10), F.lit(".example")))
    leaf = sets.select("site", F.concat(F.lit("https://"), "site", F.lit("/m"), "s", F.lit(".xml")).alias("url"), "xml")
    index = leaf.groupBy("site").agg(F.array_join(F.transform(F.collect_list("url"), lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))), "").alias("x"))
    roots = index.select(F.concat(F.lit("https://"), "site", F.lit("/sitemap_index.xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), "x", F.lit("</sitemapindex>")).alias("xml"))
    return sitemaps.job_urls(index.select("site"), leaf.select("url", "xml").union(roots)).select("site", "loc")


@query("SELECT c_custkey AS k, NOT (c_custkey % 3 = 0 AND c_custkey % 2 = 0) AS robots_allowed FROM customer")
def robots_filter(spark, sf_dir):
    k = F.col("c_custkey")
    pages = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("k"), F.concat(F.lit("https://h"), k % 3, F.lit(".example/"), F.when(k % 2 == 0, "private/").otherwise("open/"), k).alias("url"))
    robots = spark.createDataFrame([("h0.example", "User-agent: *\nDisallow: /private/"), ("h1.example", "User-agent: other\nDisallow: /")], "netloc string, body string")
    return sitemaps.allowed(pages, robots).select("k", "robots_allowed")


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'scheme' WHEN 1 THEN 'localhost' WHEN 2 THEN 'private address' WHEN 3 THEN 'private address' END AS reason FROM pages")
def blocked_urls(spark, sf_dir):
    url = F.get(F.array(*map(F.lit, ["ftp://x.example/", "http://localhost/a", "http://10.0.0.8/", "http://[::1]/", "https://8.8.8.8/"])), (F.col("page_id") % 5).cast("int"))
    return _pages(spark, sf_dir).select("page_id", urls.blocked_reason(url).alias("reason"))


# Audit


@query(f"""WITH {_EVENTS} SELECT event_id, source, status, count(*) OVER w AS n, avg(CASE WHEN status = 'salvaged' THEN 1.0 ELSE 0.0 END) OVER w AS rate FROM (SELECT *, epoch_us(ts) // 1000000 AS t FROM e)
WINDOW w AS (PARTITION BY source, model ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""")
def salvage_rate_24h(spark, sf_dir):
    return audit.salvage_rates(_events(spark, sf_dir)).select("event_id", "source", "status", "n", "rate")


@query(f"""WITH {_EVENTS}, r AS (SELECT event_id, source, status, count(*) OVER w AS n, avg(CASE WHEN status = 'salvaged' THEN 1.0 ELSE 0.0 END) OVER w AS rate FROM (SELECT *, epoch_us(ts) // 1000000 AS t FROM e)
WINDOW w AS (PARTITION BY source, model ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)) SELECT event_id, source, n, rate FROM r WHERE status = 'salvaged' AND rate > 0.1""")
def salvage_alerts(spark, sf_dir):
    return audit.salvage_alerts(audit.salvage_rates(_events(spark, sf_dir))).select("event_id", "source", "n", "rate")


@query(f"""WITH {_EVENTS} SELECT source, model, count(*) FILTER (status = 'clean') AS clean, count(*) FILTER (status = 'salvaged') AS salvaged, count(*) FILTER (status = 'truncated') AS truncated,
 count(*) FILTER (status = 'failed') AS failed FROM e GROUP BY source, model""")
def status_counts(spark, sf_dir):
    return audit.status_counts(_events(spark, sf_dir))


@query(f"WITH c AS ({CUSTOMERS_SQL}), g AS (SELECT p, count(*) AS declared, count(*) FILTER (k % 7 <> 0) AS parsed FROM c GROUP BY p) SELECT 'https://boards.greenhouse.io/b' || p AS url, CAST(parsed AS INTEGER) AS parsed, declared FROM g WHERE parsed < declared")
def listing_completeness(spark, sf_dir):
    pages = payload_pages(spark, sf_dir, "greenhouse").withColumn("declared", F.size(F.try_variant_get(F.try_parse_json("content"), "$.jobs", "array<variant>")).cast("long"))
    return audit.completeness(listings.listings(pages, "greenhouse"))


@query(f"WITH c AS ({CUSTOMERS_SQL}) SELECT '{_PROVIDERS[0]}' AS provider, count(*) FILTER (k % 7 <> 0) AS jobs FROM c UNION ALL SELECT 'lever', count(*) FROM c UNION ALL SELECT 'breezy', count(*) FILTER (k % 7 <> 0) FROM c")
def registry_dispatch(spark, sf_dir):
    """Pages of three providers in one table, each read by its own parser."""
    parts = [payload_pages(spark, sf_dir, p) for p in ("greenhouse", "lever", "breezy")]
    pages = parts[0].union(parts[1]).union(parts[2]).withColumn("provider", detect.provider_of_url(F.col("url")))
    return listings.listings_by_provider(pages, only=["greenhouse", "lever", "breezy"]).groupBy("provider").agg(F.sum(F.size("jobs")).cast("long").alias("jobs"))
