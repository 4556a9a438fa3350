"""Queries of the fetch contract, provider addresses, extraction in tiers and model answers, with their SQL.

The tables carry no fetches or answers, so the queries build them from keys; the SQL says what must come of each by its own patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelode.functions import urls, values
from pagelode.operators import audit, extraction, incremental, model_output, scrape
from pagelode.plans.registry import query, read
from pagelode.sources import fetches, sitemaps

# Fetches


@query(r"""WITH f AS (SELECT page_id, html, CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 200 ELSE 503 END AS status FROM pages)
SELECT page_id, CASE WHEN strlen(html) > 3000 THEN 'response too large' WHEN status >= 400 THEN 'HTTP ' || status || ': ' || left(html, 200) END AS error,
 CASE WHEN strlen(html) <= 3000 AND status < 400 THEN html END AS content FROM f""")
def fetch_limits(spark, sf_dir):
    k = F.col("page_id") % 4
    rows = read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"), F.when(k == 1, 404).when(k == 3, 503).otherwise(200).alias("status_code"))
    return fetches.with_limits(rows, 3000).select("page_id", "error", "content")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 2 = 1 THEN left('{' || repeat(c_mktsegment, 90), 500) END AS raw_text FROM customer""")
def fetch_body(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    content = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.col("c_name").alias("name")))).otherwise(F.concat(F.lit("{"), F.repeat("c_mktsegment", F.lit(90))))
    body = fetches.body_data(content)
    return c.select(F.col("c_custkey").alias("k"), values.get(body, "$.name", "string").alias("name"), values.get(body, "$.raw_text", "string").alias("raw_text"))


@query("""SELECT page_id, page_id % 4 IN (0, 2) AS not_modified, CASE WHEN page_id % 4 IN (0, 2) THEN 'kept ' || page_id ELSE html END AS content FROM pages""")
def conditional_scan(spark, sf_dir):
    """By etag (the same, another), and without one by last_modified (the same, none)."""
    k = F.col("page_id") % 4
    p = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("u"), "page_id").alias("url"), F.col("html").alias("content"))
    now = p.withColumn("etag", F.when(k == 0, "a").when(k == 1, "b")).withColumn("last_modified", F.when(k < 3, "Mon"))
    old = p.select("url", F.when(k < 2, "a").alias("etag"), F.lit("Mon").alias("last_modified"), F.concat(F.lit("kept "), "page_id").alias("content"))
    return incremental.conditional(now, old).select(F.substring("url", 2, 20).cast("long").alias("page_id"), "not_modified", "content")


@query("""WITH p AS (SELECT c_custkey % 50 AS board, c_custkey // 50 * 100 AS skip, CASE c_custkey % 7 WHEN 0 THEN 40 WHEN 1 THEN 0 ELSE 100 END AS n FROM customer)
SELECT CAST(board AS VARCHAR) AS board, CAST(skip AS BIGINT) AS skip FROM p a WHERE n > 0 AND skip < 5000
 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.board = a.board AND b.skip < a.skip AND b.n < 100)""")
def paged_scan(spark, sf_dir):
    k = F.col("c_custkey")
    n = F.when(k % 7 == 0, 40).when(k % 7 == 1, 0).otherwise(100)
    content = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("{}"), n), ","), F.lit("]"))
    rows = read(spark, sf_dir, "customer").select((k % 50).cast("string").alias("board"), (F.floor(k / 50) * 100).cast("long").alias("skip"), content.alias("content"))
    return fetches.paged(rows).select("board", "skip")


@query("SELECT s_nationkey AS kind, arg_min('http://e' || s_suppkey, s_suppkey) AS url FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey")
def first_healthy_endpoint(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("kind"), F.col("s_suppkey").alias("ord"), F.concat(F.lit("http://e"), "s_suppkey").alias("url"), (F.col("s_acctbal") > 0).alias("healthy"))
    return fetches.healthy_endpoint(s)


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 5 < 4 THEN c_name END AS text FROM customer")
def ocr_answers(spark, sf_dir):
    """An answer's text in each of its four places, empty ones in front, and one without any."""
    k = F.col("c_custkey") % 5
    answer = (
        F.when(k == 0, F.format_string('{"markdown":"%s","text":"t"}', "c_name")).when(k == 1, F.format_string('{"markdown":"","text":"%s"}', "c_name"))
        .when(k == 2, F.format_string('{"content":"%s"}', "c_name")).when(k == 3, F.format_string('{"choices":[{"message":{"content":"%s"}}]}', "c_name")).otherwise('{"pages":1}')
    )
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), fetches.ocr_text(answer).alias("text"))


@query("""WITH s AS (SELECT a, b, d FROM (VALUES (200), (403)) x(a), (VALUES (200), (403), (NULL)) y(b), (VALUES (200), (500), (NULL)) z(d)),
r AS (SELECT p.page_id, a, b, d, length(trim(regexp_replace(html, '<[^>]+>', ' ', 'g'))) < 200 AS sparse FROM pages p, s),
t AS (SELECT *, a = 403 AND b = 200 AS second FROM r),
u AS (SELECT *, CASE WHEN a = 403 AND NOT coalesce(second, false) THEN 'TIER3_403' WHEN NOT coalesce(second, false) AND sparse THEN 'TIER3_EMPTY_200' END AS tier3_reason FROM t)
SELECT page_id, a, b, d, tier3_reason, CASE WHEN tier3_reason IS NOT NULL AND d = 200 THEN 3 WHEN second THEN 2 ELSE 1 END AS fetch_tier,
 CASE WHEN tier3_reason IS NOT NULL AND d = 200 THEN 200 WHEN second THEN 200 ELSE a END AS status_code FROM u""")
def fetch_tier(spark, sf_dir):
    """Every combination of what the three tiers may answer, for every page."""
    tries = F.explode(F.expr("flatten(transform(array(200, 403), a -> flatten(transform(array(200, 403, null), b -> transform(array(200, 500, null), d -> struct(a, b, d))))))"))
    p = read(spark, sf_dir, "pages").select("page_id", "html", tries.alias("t")).select("page_id", "t.*", F.col("a").alias("status_code"), F.col("html").alias("content"))
    full = F.repeat(F.lit("text "), F.lit(100))
    p = p.withColumns({"tier2_status": F.col("b"), "tier2_content": full, "tier3_status": F.col("d"), "tier3_content": full})
    return scrape.with_fetch_tier(p).select("page_id", "a", "b", "d", "tier3_reason", "fetch_tier", "status_code")


@query("""WITH e AS (SELECT o_orderkey AS k, 'u' || (o_custkey % 500) AS url, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders),
s AS (SELECT url, ts, 'h' || max(k) AS content_hash FROM e WHERE k % 3 = 0 GROUP BY url, ts)
SELECT e.url, e.ts, e.k, s.ts AS prev_ts, s.content_hash AS prev_hash FROM e ASOF LEFT JOIN s ON e.url = s.url AND e.ts >= s.ts""")
def latest_scrape(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("u"), F.col("o_custkey") % 500).alias("url"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    scrapes = o.where("k % 3 = 0").groupBy("url", "ts").agg(F.concat(F.lit("h"), F.max("k")).alias("content_hash"))
    return incremental.latest_before(o, scrapes).select("url", "ts", "k", "prev_ts", "prev_hash")


# Addresses

_HOSTS = ["https://boards.greenhouse.io/b{k}/jobs/1", "https://jobs.lever.co/b{k}", "https://jobs.smartrecruiters.com/b{k}", "https://b{k}.teamtailor.com/jobs", "https://b{k}.recruitee.com/", "https://b{k}.pinpointhq.com/x", "https://b{k}.breezy.hr/p/1", "https://api.b{k}.successfactors.com/careers"]
_KINDS = ["greenhouse", "lever", "smartrecruiters", "teamtailor", "recruitee", "pinpoint", "breezy", "sap_successfactors"]
_WANTED = [
    "https://boards-api.greenhouse.io/v1/boards/b{k}/jobs?content=true", "https://api.lever.co/v0/postings/b{k}?mode=json", "https://api.smartrecruiters.com/v1/companies/b{k}/postings",
    "https://api.teamtailor.com/v1/jobs?filter[company-slug]=b{k}", "https://b{k}.recruitee.com/api/offers", "https://b{k}.pinpointhq.com/jobs.json", "https://b{k}.breezy.hr/json",
    "https://api.b{k}.successfactors.com/odata/v2/JobRequisition?$format=json",
]


def _numbered(templates: list[str]) -> str:
    return "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN replace('{t}', '{{k}}', CAST(c_custkey AS VARCHAR))" for i, t in enumerate(templates)) + " END"


@query(rf"""SELECT c_custkey AS k, {_numbered(_WANTED)} AS api, regexp_extract(u, '^(https://[^/]+)', 1) || '/robots.txt' AS robots,
 regexp_extract(u, '^(https://[^/]+)', 1) || '/sitemal.xml' AS sitemap FROM (SELECT *, {_numbered(_HOSTS)} AS u FROM customer)""")
def provider_addresses(spark, sf_dir):
    k = (F.col("c_custkey") % 8).cast("int")
    url = F.replace(F.get(F.array(*map(F.lit, _HOSTS)), k), F.lit("{k}"), F.col("c_custkey").cast("string"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), url.alias("url"), F.get(F.array(*map(F.lit, _KINDS)), k).alias("provider"))
    u = F.col("url")
    return rows.select("k", urls.provider_api(u, F.col("provider")).alias("api"), urls.robots_url(u).alias("robots"), urls.sap_sitemap(u).alias("sitemap"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'j' || c_custkey WHEN 1 THEN 'l' || c_custkey WHEN 2 THEN 'p' || c_custkey ELSE 'h' || c_custkey END AS slug,
 '{"query":"query Q","variables":{"organizationHostedJobsPageName":"' || CASE c_custkey % 5 WHEN 0 THEN 'j' || c_custkey WHEN 1 THEN 'l' || c_custkey WHEN 2 THEN 'p' || c_custkey ELSE 'h' || c_custkey END || '"}}' AS payload FROM customer""")
def ashby_request(spark, sf_dir):
    """The board's name from the page's JSON, its links (`api` is none), the URL's path, or its host; and the request for it."""
    key, k = F.col("c_custkey"), F.col("c_custkey") % 5
    url = F.when(k < 3, F.format_string("https://h%d.example.com/p%d/job", key, key)).when(k == 3, F.format_string("https://h%d.example.com/api/x", key)).otherwise(F.format_string("https://h%d.example.com", key))
    page = F.when(k == 0, F.format_string('ashbyhq.com/z {"organizationHostedJobsPageName": "j%d"}', key)).when(k == 1, F.format_string('ashbyhq.com/api/ "https://jobs.ashbyhq.com/l%d"', key)).otherwise("")
    rows = read(spark, sf_dir, "customer").select(key.alias("k"), urls.ashby_slug(url, page).alias("slug"))
    return rows.select("k", "slug", urls.ashby_payload(F.col("slug"), "query Q").alias("payload"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS TIMESTAMP) WHEN 1 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 5 HOUR END AS lastmod_ts FROM orders""")
def sitemap_times(spark, sf_dir):
    """A day, a time with an offset, and text that is no time."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 3
    last = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit("T03:00:00-02:00"))).otherwise("soon")
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 50).alias("s"), F.format_string("<url><loc>https://x/%d</loc><lastmod>%s</lastmod></url>", "o_orderkey", last).alias("x"))
    sets = o.groupBy(F.concat(F.lit("s"), "s", F.lit(".example")).alias("site")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("x"), ""), F.lit("</urlset>")).alias("xml"))
    found = sitemaps.job_urls(sets.select("site"), sets.select(F.concat(F.lit("https://"), "site", F.lit("/sitemap.xml")).alias("url"), "xml"))
    return found.select(F.regexp_extract("loc", r"(\d+)$", 1).cast("long").alias("k"), "lastmod_ts")


# Extraction


@query(r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 END AS tier, CASE page_id % 4 WHEN 0 THEN 'S' || page_id WHEN 1 THEN 'M' || page_id WHEN 2 THEN 'H' || page_id END AS title,
 CASE page_id % 4 WHEN 0 THEN 'https://j.example/' || page_id WHEN 1 THEN 'https://m.example/' || page_id WHEN 2 THEN 'https://h.example/' || page_id END AS url,
 CASE page_id % 4 WHEN 0 THEN '$1,000–$2,000/year' WHEN 1 THEN 'USD 5,000+' END AS salary_range FROM pages""")
def tiered_extraction(spark, sf_dir):
    """Pages with structured data; pages that the local model reads; pages whose local answer breaks the schema, so that the hosted one is
    asked; pages in which none finds anything."""

    def local(texts, limit):
        out = []
        for t in texts:
            mark, _, n = next((w for w in t.split() if w.startswith("key-")), "key-x-0").rpartition("-")
            item = f'{{"title":"M{n}","url":"https://m.example/{n}","salary_min":"5000"}}'
            out.append((f'```json\n{{"items":[{item}]}}\n```' if mark == "key-local" else f'[{item},{{"title":"no address"}}]', False))
        return out

    def hosted(texts, limit):
        out = []
        for t in texts:
            mark, _, n = next((w for w in t.split() if w.startswith("key-")), "key-x-0").rpartition("-")
            out.append((f'{{"jobs":[{{"title":"H{n}","url":"https://h.example/{n}"}}]}}' if mark == "key-hosted" else '{"jobs":[]}', False))
        return out

    k = F.col("page_id") % 4
    pay = '"baseSalary":{"currency":"USD","value":{"minValue":1000,"maxValue":2000,"unitText":"YEAR"}}'
    data = F.format_string('<script type="application/ld+json">{"@type":"JobPosting","title":"S%d","url":"https://j.example/%d",' + pay + "}</script>", "page_id", "page_id")
    mark = F.when(k == 0, data).when(k == 1, F.concat(F.lit("<p>key-local-"), "page_id", F.lit("</p>"))).when(k == 2, F.concat(F.lit("<p>key-hosted-"), "page_id", F.lit("</p>"))).otherwise("")
    pages = read(spark, sf_dir, "pages").select("page_id", F.concat(mark, "html").alias("html"))
    first = F.get("jobs", F.lit(0))
    return extraction.extract(pages, local, hosted).select("page_id", "tier", first["title"].alias("title"), first["url"].alias("url"), first["salary_range"].alias("salary_range"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE 1 END AS n,
 CASE c_custkey % 6 WHEN 0 THEN 'USD 1,000–2,500' WHEN 1 THEN 'EUR 90,000+' END AS pay FROM customer""")
def schema_listings(spark, sf_dir):
    """An envelope, an array, an item without a title, one of a wrong type, no JSON, and nulls in optional fields."""
    k = F.col("c_custkey") % 6
    good = '{"title":"T","url":"u","salary_min":1000,"salary_max":"2500"}'
    answer = (
        F.when(k == 0, f'```json\n{{"items":[{good},{good}]}}\n```').when(k == 1, '[{"title":"T","url":"u","salary_min":90000,"salary_currency":"EUR"}]')
        .when(k == 2, f'[{good},{{"url":"u"}}]').when(k == 3, f'[{good},{{"title":"T","url":"u","salary_min":"much"}}]').when(k == 4, "sorry").otherwise('[{"title":"T","url":"u","location":null}]')
    )
    jobs = extraction.schema_listings(answer)
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.size(jobs).alias("n"), F.get(jobs, F.lit(0))["salary_range"].alias("pay"))


@query(r"""WITH a AS (SELECT page_id, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<nav\b.*?</nav>|<header\b.*?</header>|<footer\b.*?</footer>|<aside\b.*?</aside>|<form\b.*?</form>|<button\b.*?</button>', '', 'g'), '\s+', ' ', 'g'),
 '(?i)<h1\b[^>]*>', chr(10) || '# ', 'g'), '(?i)<h2\b[^>]*>', chr(10) || '## ', 'g'), '(?i)<h3\b[^>]*>', chr(10) || '### ', 'g'), '(?i)<h4\b[^>]*>', chr(10) || '#### ', 'g'), '(?i)<h5\b[^>]*>', chr(10) || '##### ', 'g'), '(?i)<li\b[^>]*>', chr(10) || '- ', 'g'),
 '(?i)<a\s[^>]*?href=["'']([^"'']+)["''][^>]*>\s*([^<]*?)\s*</a>', '[\2](\1)', 'g'), '(?i)</?(p|div|section|article|main|ul|ol|table|tr|br|h[1-6])\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'), chr(10))) AS line,
 FROM pages), b AS (SELECT page_id, trim(line) AS line, row_number() OVER () AS n FROM a)
SELECT p.page_id, string_agg(b.line, chr(10) ORDER BY n) AS markdown FROM pages p LEFT JOIN b ON p.page_id = b.page_id AND NOT regexp_full_match(b.line, '[-#]*') GROUP BY p.page_id""")
def page_markdown(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", extraction.markdown(F.col("html")).alias("markdown"))


@query("""SELECT page_id, CAST(CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS postings, 'JobPosting' AS type, 'T' || page_id AS title, 'https://j.example/' || page_id AS url, 'Town' AS place, 'website' AS og FROM pages""")
def structured_page_data(spark, sf_dir):
    """JSON-LD, microdata (an item in another one is its own) and OpenGraph of a page."""
    item = '<div itemscope itemtype="https://schema.org/JobPosting"><h2 itemprop="title"> T%d </h2><a itemprop="url" href="https://j.example/%d">go</a><i itemprop="title">again</i><span itemprop="place" itemscope itemtype="http://schema.org/Place"><b itemprop="name">Town</b></span></div>'
    ld = F.when(F.col("page_id") % 2 == 0, '<script type="application/ld+json">[{"@type":"JobPosting"},{"@type":"Place"}]</script>').otherwise("")
    html = F.concat(F.lit('<meta property="og:type" content="website">'), ld, F.format_string(item, "page_id", "page_id"), "html")
    rows = read(spark, sf_dir, "pages").select("page_id", extraction.structured_data(html).alias("d"))
    one, two = F.get("d.microdata", F.lit(0)), F.get("d.microdata", F.lit(1))
    return rows.select(
        "page_id", F.size("d.job_postings").alias("postings"), one["type"].alias("type"), one["properties"]["title"].alias("title"), one["properties"]["url"].alias("url"),
        two["properties"]["name"].alias("place"), F.col("d.opengraph")["type"].alias("og"),
    )


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS chunk, l_partkey % 3 AS p, l_suppkey % 5 AS s FROM lineitem),
a AS (SELECT k, chunk, p, CASE WHEN s = 0 THEN 3 WHEN s = 1 THEN 2 ELSE 0 END AS bad FROM l), w AS (SELECT k, max(bad) AS bad FROM a GROUP BY k),
f AS (SELECT k, count(DISTINCT p) AS jobs FROM a WHERE bad < 2 GROUP BY k), g AS (SELECT k, min(chunk) AS c FROM a WHERE bad < 2 GROUP BY k)
SELECT 'u' || w.k AS url, CASE w.bad WHEN 0 THEN 'clean' ELSE 'failed' END AS parse_status, CAST(coalesce(f.jobs, 0) AS INTEGER) AS jobs, 'c' || g.c AS first FROM w LEFT JOIN f USING (k) LEFT JOIN g USING (k)
WHERE w.k NOT IN (SELECT k FROM a GROUP BY k HAVING min(bad) = 2 AND max(bad) = 2) UNION ALL
SELECT 'u' || k, 'truncated', 0, NULL FROM a GROUP BY k HAVING min(bad) = 2 AND max(bad) = 2""")
def chunk_answers(spark, sf_dir):
    """The chunks of an order's page: answers with a job, broken ones, and cut-off ones. The first of equal URLs stays, the worst status counts."""
    s = F.col("l_suppkey") % 5
    job = F.format_string('{"jobs":[{"title":"c%d","url":"https://j.example/%d"}]}', "l_linenumber", F.col("l_partkey") % 3)
    rows = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("u"), "l_orderkey").alias("url"), F.col("l_linenumber").alias("chunk"), F.when(s == 0, "none").otherwise(job).alias("answer"), (s == 1).alias("cut_off"))
    found = model_output.model_listings(rows)
    return found.select("url", "parse_status", F.size("jobs").alias("jobs"), F.get("jobs", F.lit(0))["title"].alias("first"))


# Batches


@query("""WITH i AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 100 END AS p, c_custkey % 37 AS b FROM customer),
g AS (SELECT b, min(ord) AS first FROM i WHERE p IS NULL GROUP BY b)
SELECT count(*) FILTER (p IS NULL AND b % 3 = 0) AS failed, count(*) FILTER (p IS NULL AND b % 3 <> 0) AS with_jobs, count(*) FILTER (p IS NOT NULL) AS without_jobs FROM i""")
def batch_tally(spark, sf_dir):
    """Every input row gets its representative's outcome; some boards can't be fetched."""
    k = F.col("c_custkey")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://example.com/jobs/p"), k % 100)).otherwise(F.concat(F.lit("https://boards.greenhouse.io/b"), k % 37, F.lit("/jobs/"), k))
    rows = read(spark, sf_dir, "customer").select(k.alias("ord"), url.alias("url"), F.when((k % 4 != 0) & (k % 37 % 3 == 0), 500).otherwise(200).alias("status_code"))
    api = F.lit('{"jobs":[{"title":"T","absolute_url":"https://j.example/1"}]}')
    work = rows.dropDuplicates(["url"]).select("url", "status_code", F.lit("<h1>Careers</h1>").alias("content"), api.alias("api_content"))
    return audit.outcome_tally(scrape.scrape_batch(rows.select("ord", "url"), work, only=["greenhouse"]))


@query("""SELECT s.source, s.model, s.status, count(*) AS events FROM (SELECT 's' || (user_id % 20) AS source, 'm' || (user_id % 3) AS model, event_type AS status FROM events) s GROUP BY GROUPING SETS ((source, model, status), (source, model), (source), ())""")
def status_rollup(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select(F.concat(F.lit("s"), F.col("user_id") % 20).alias("source"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.col("event_type").alias("status"))
    return audit.status_rollup(rows)
