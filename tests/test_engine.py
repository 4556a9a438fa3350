"""Operators on small inputs: edges that the tables don't hold."""

import json

import pytest
from pyspark.sql import functions as F

from pagelode.functions import text, urls
from pagelode.functions.urls import _blocked, _exact_normal
from pagelode.operators import audit, detect, incremental, listings, model_output, scrape, validate
from pagelode.sources import fetches, sitemaps


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first()["x"]


def jobs(spark, provider, content, url="https://x.example/a"):
    df = spark.createDataFrame([(url, content)], "url string, content string")
    return listings.listings(df, provider).first()["jobs"]


@pytest.mark.parametrize("provider", listings.registered())
def test_nothing_in_nothing_out(spark, provider):
    bad = [None, "", "not json", "[]", "5", "null", '{"jobs":5,"offers":null,"data":{},"d":[1]}']
    df = spark.createDataFrame([("https://x.example/a", c) for c in bad], "url string, content string")
    assert all(r.jobs == [] for r in listings.listings(df, provider).collect() if not (provider == "lever" and (r.content or "").startswith("{")))


def test_strict_types_drop_rows(spark):
    rows = [{"title": 1, "absolute_url": "https://a.example"}, {"title": "ok", "absolute_url": "https://a.example"}, {"title": "x", "absolute_url": "ftp://a"}, {"title": "y", "absolute_url": "https://b.example", "location": {"name": 3}}, 7, None]
    found = jobs(spark, "greenhouse", json.dumps({"jobs": rows, "meta": None}))
    assert [(j.title, j.url) for j in found] == [("ok", "https://a.example/")]


def test_lever_single_object_and_default_title(spark):
    (job,) = jobs(spark, "lever", json.dumps({"id": "9", "salaryRange": {"max": 1000, "currency": "EUR"}}))
    assert (job.title, job.url, job.salary_range) == ("Untitled Position", "https://jobs.lever.co/unknown/9", "EUR up to 1,000")


def test_ashby_error_and_single(spark):
    assert jobs(spark, "ashby", json.dumps({"errors": [{"message": "x"}], "data": {"jobBoard": None}})) == []
    (job,) = jobs(spark, "ashby", json.dumps({"data": {"jobPosting": {"title": "T", "id": "1", "locationName": "Remote EU", "isRemote": True}}}))
    assert job.location == "Remote EU"


def test_workday_blob_stops_at_first_bracket(spark):
    html = '{"jobPostings":[{"title":"a","externalUrl":"/x","locationsText":"L"}]} {"jobPosting":[{"title":"b","tags":["q"]}]}'
    assert [(j.title, j.url, j.location) for j in jobs(spark, "workday", html)] == [("a", "https://x.example/x", "L")]


def test_icims_links_near_titles(spark):
    html = '<a href="/jobs/12/job" title="Cook">go</a><a href="/jobs/12/job">again</a>' + " " * 400 + '<a href="/jobs/13/job" class="z"> Baker </a>'
    assert [(j.title, j.url) for j in jobs(spark, "icims", html)] == [("Cook", "https://x.example/jobs/12/job"), ("Baker", "https://x.example/jobs/13/job")]


def test_eightfold_cards_without_structured_data(spark):
    html = '<div class="efai-job"><h2>A</h2><a href="https://o.example/1">x</a></div><li class="job-card"><h3></h3></li>'
    assert [(j.title, j.url) for j in jobs(spark, "eightfold", html)] == [("A", "https://o.example/1")]


def test_sap_envelopes_and_dates(spark):
    (job,) = jobs(spark, "sap_successfactors", json.dumps({"d": [{"JobTitle": "T", "JobReqId": 4, "postingDate": "/Date(0+0100)/"}]}))
    assert job.url == "https://x.example/job/4" and str(job.posted_date) == "1970-01-01 00:00:00"


def test_json_ld_salaries(spark):
    def ld(salary):
        return f'<script type="application/ld+json">{json.dumps({"@type": "JobPosting", "title": "T", "baseSalary": salary})}</script>'

    got = [jobs(spark, "workday", ld(s))[0].salary_range for s in ({"currency": "USD", "value": 5000}, {"currency": "GBP", "value": {"value": 10, "unitText": "HOUR"}}, {"value": "x"}, "no")]
    assert got == ["$5,000", "GBP 10/hour", None, None]


def test_own_parser_is_registered(spark):
    @listings.parser("mine")
    def mine(content, page):
        return listings._rows(F.array(F.try_parse_json(content)), lambda x: listings._listing("mine", F.lit("t"), page, F.to_json(x)))

    try:
        df = spark.createDataFrame([("https://a.example/", "{}", "mine"), ("https://b.example/", "{}", None)], "url string, content string, provider string")
        found = {r.url: len(r.jobs) for r in listings.listings_by_provider(df, only=["mine"]).collect()}
        assert found == {"https://a.example/": 1, "https://b.example/": 0}
    finally:
        listings._PARSERS.pop("mine")


def test_text_helpers(spark):
    assert one(spark, text.strip(F.col("a")), a="　 x \x1f") == "x"
    assert one(spark, text.clean_lines(F.col("a")), a='<script>x</script><p>a <a href="/u"><b>l</b></a> b</p><a href="/v"></a>') == "a l (/u) b\n/v"
    assert one(spark, text.chunk_lines(F.col("a"), 5), a="ab\ncd\nlonger line\n\nx") == ["ab\ncd", "longer line", "\nx"]
    assert one(spark, text.without_fences(F.col("a")), a="```json\n{}\n```") == "{}"
    assert one(spark, text.stable_key(*(F.col(c) for c in "abcd")), a="", b=None, c="", d=None) == "unknown"


def test_urls(spark):
    assert [_exact_normal(u) for u in ("HTTPS://É.example:443", "http://e.com:8080/a/../b/./c?x=1", "/rel", "mailto:a@b", None, "https://e.com?x=1")] == [
        "https://xn--9ca.example/", "http://e.com:8080/b/c?x=1", None, None, None, "https://e.com/?x=1",
    ]
    assert [_blocked(u) for u in ("http://192.168.1.1/", "http://[fe80::1]/", "gopher://x", "http://", "https://example.com")] == ["private address", "private address", "scheme", "no host", None]
    base = "https://a.example/b/c?d#e"
    for ref in ("x", "/x", "//h.example/x", "?q", "#f", "https://z.example/", "mailto:x@y"):
        assert one(spark, urls.join(F.col("a"), F.col("b")), a=base, b=ref) == one(spark, urls.exact_join(F.col("a"), F.col("b")), a=base, b=ref)
    assert one(spark, urls.exact_join(F.col("a"), F.col("b")), a=base, b="../x") == "https://a.example/x"
    assert one(spark, urls.ashby_slug(F.col("u"), F.col("h")), u="https://jobs.ashbyhq.com/o1", h="ashbyhq.com/api/x ashbyhq.com/real") == "real"
    api = {"recruitee": "https://a.example/api/offers", "pinpoint": "https://a.example/jobs.json", "breezy": "https://a.example/json", "sap_successfactors": "https://a.example/odata/v2/JobRequisition?$format=json"}
    for provider, want in api.items():
        assert one(spark, urls.provider_api(F.col("u"), F.lit(provider)), u="https://a.example/x") == want


def test_first_url_rule_and_best_dom_rule(spark):
    assert one(spark, detect.provider_of_url(F.col("a")), a="https://boards.greenhouse.io/x?jobs.lever.co") == "greenhouse"
    assert one(spark, detect.provider_of_url(F.col("a")), a="https://JOBS.LEVER.CO/x") == "unknown"
    assert one(spark, detect.provider_of_dom(F.col("a")), a="workday lever-jobs-container greenhouse id='greenhouse'") == "greenhouse"
    assert detect.fingerprints(spark).count() == 36


def test_a_posting_in_a_deep_graph_is_found(spark):
    body = {"@graph": [{"@graph": [{"@graph": [{"@graph": [{"@graph": [{"@type": "JobPosting"}]}]}]}]}]}
    deep = f'<script type="application/ld+json">{json.dumps(body)}</script>'
    endless = '<script type="application/ld+json">' + '{"@graph":[' * 5000 + "]}" * 5000 + "</script>"
    rows = spark.createDataFrame([(1, deep), (2, endless), (3, None)], "id long, html string").selectExpr("*", "'https://e.org' AS url", "'unknown' AS provider")
    found = {r.id: r.reason_code for r in validate.with_validation(rows).collect()}
    assert found[1] == "schema_job_posting" and found[2] != "schema_job_posting" and found[3] != "schema_job_posting"


def test_types_of_deep_graphs(spark):
    body = {"@type": "A", "@graph": [{"@graph": [{"@graph": [{"@graph": [{"@graph": [{"@type": ["B", "C"]}]}]}]}]}]}
    html = f'<script type="application/ld+json">{json.dumps(body)}</script>'
    assert one(spark, validate.json_ld_types_deep(F.col("a")), a=html) == ["A", "B", "C"]
    assert one(spark, validate.json_ld_types(F.col("a")), a=html) == ["A"]
    assert one(spark, validate.opengraph(F.col("a")), a='<meta property="og:type" content="x"><meta property="og:type" content="y">') == {"type": "x"}


def test_fetch_contract(spark):
    df = spark.createDataFrame([("u", 200, "ok"), ("v", 500, "e" * 300), ("w", 200, "x" * 500)], "url string, status_code int, content string")
    rows = {r.url: r for r in fetches.with_limits(df, 400).collect()}
    assert rows["u"].error is None and len(rows["v"].error) == len("HTTP 500: ") + 200 and rows["w"].error == "response too large"
    assert json.loads(one(spark, F.to_json(fetches.body_data(F.col("a"))), a="plain")) == {"raw_text": "plain"}
    pages = spark.createDataFrame([("b", 0, "[1,2]"), ("b", 2, "[1]"), ("b", 4, "[1,2]")], "board string, skip int, content string")
    assert [r.skip for r in fetches.paged(pages, 2).orderBy("skip").collect()] == [0, 2]
    assert one(spark, fetches.ocr_text(F.col("a")), a='{"markdown":"","choices":[{"message":{"content":"m"}}]}') == "m"


def test_sitemaps(spark):
    urlset = "<urlset><url><loc>https://a.example/1</loc></url><url><loc> </loc></url></urlset>"
    assert [e.loc for e in one(spark, sitemaps.sitemap_entries(F.col("a")), a=urlset)] == ["https://a.example/1"]
    for broken in ("", "<urlset><url>", "text", None):
        assert one(spark, sitemaps.sitemap_entries(F.col("a")), a=broken) == []


def test_state_moves(spark):
    entries = spark.createDataFrame([("a", "2"), ("b", None)], "url string, lastmod string")
    state = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "url string, lastmod string")
    assert sorted(map(tuple, incremental.next_state(entries, state).collect())) == [("a", "2"), ("c", "1")]
    f = spark.createDataFrame([("a", "e", "new")], "url string, etag string, content string")
    s = spark.createDataFrame([("a", "e", "old")], "url string, etag string, content string")
    assert incremental.conditional(f, s).first()["content"] == "old"


@pytest.mark.parametrize(
    ("broken", "want"),
    [('{"jobs":[{"title":"a","url":"u"},]}', 1), ('{"jobs":[{"title":"a","url":"u"},{"title":"b', 1), ("{'jobs':[{'title':'a','url':'u'}]}", 1), ("no json", None), ('text {"jobs":[]} tail', 0)],
)
def test_repair(broken, want):
    fixed = model_output.repaired(broken)
    assert (None if fixed is None else sum("url" in j for j in json.loads(fixed)["jobs"])) == want


def test_model_ladder(spark):
    def model(texts, limit):
        return [('{"jobs":[{"title":"t","url":"https://j.example/%s"}]}' % ("long" if len(t) > 20 else t[:1]), len(t) > 20 and limit < 10**9) for t in texts]

    pages = spark.createDataFrame([("u", "<p>a</p>"), ("v", "<p>" + "b" * 30 + "</p>")], "url string, html string")
    out = {r.url: r for r in model_output.model_listings(model_output.ask_model(pages, model)).collect()}
    assert out["u"].parse_status == "clean" and len(out["u"].jobs) == 1
    assert out["v"].parse_status == "truncated" and out["v"].jobs == []
    assert one(spark, model_output.schema_jobs(F.col("a"))["title"], a='{"items":[{"title":"a"},{"title":"b"}]}') == ["a", "b"]
    assert one(spark, model_output.schema_jobs(F.col("a")), a='[{"title":"a"},{"x":1}]') is None


def test_batch_rows_fan_out(spark):
    inputs = spark.createDataFrame([(0, "https://boards.greenhouse.io/b/1"), (1, "https://boards.greenhouse.io/b/2"), (2, "https://e.example/jobs"), (3, "https://e.example/jobs")], "ord int, url string")
    body = '{"jobs":[{"title":"T","absolute_url":"https://j.example/1"}]}'
    fetched = spark.createDataFrame([("https://boards.greenhouse.io/b/1", 200, "x" * 300, body), ("https://e.example/jobs", 200, "y" * 300, None)], "url string, status_code int, content string, api_content string")
    out = scrape.scrape_batch(inputs, fetched, only=["greenhouse"]).orderBy("ord").collect()
    assert [(r.exit, len(r.jobs)) for r in out] == [("success", 1), ("success", 1), ("success", 0), ("success", 0)]
    assert audit.outcome_tally(scrape.scrape(fetched, only=["greenhouse"])).first().asDict() == {"failed": 0, "with_jobs": 1, "without_jobs": 1}


def test_change_stream(spark, tmp_path):
    from pagelode.streaming.streams import change_stream, salvage_stream

    first = spark.createDataFrame([("a", "1"), ("b", "1")], "url string, html string")
    for k, df in enumerate((first, spark.createDataFrame([("a", "1"), ("b", "2")], "url string, html string"))):
        df.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = change_stream(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.url, r.changed) for r in spark.table("changes").collect())
    assert got == [("a", False), ("a", True), ("b", True), ("b", True)]
    ev = spark.createDataFrame([("s", "m", "2024-01-01 00:00:00", "salvaged"), ("s", "m", "2024-01-01 00:30:00", "clean")], "source string, model string, ts string, status string")
    assert {r.rate for r in salvage_stream(ev).collect()} == {0.5}


def test_field_list_and_schema_edges(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType, StructField, StructType

    from pagelode.operators import extraction

    schema = StructType([StructField("title", StringType(), metadata={"comment": "Job title. Required"}), StructField("url", StringType())])
    assert extraction.field_list(schema) == "  title: Job title\n  url"
    rows = spark.createDataFrame([(None,), ("",), ("[]",), ("{}",), ('{"items":[3]}',), ('[{"title":"t","url":"u","posted_at":"2026-04-16"}]',), ('[{"title":"t","url":"u","posted_at":"soon"}]',)], "a string")
    assert [r[0] for r in rows.select(F.size(extraction.schema_listings(F.col("a")))).collect()] == [0, 0, 0, 0, 0, 1, 0]


def test_tiers_ask_only_where_nothing_was_found(spark):
    from pagelode.operators import extraction

    data = '<script type="application/ld+json">{"@type":"JobPosting","title":"a","url":"https://x/1"}</script><p>text</p>'
    pages = spark.createDataFrame([(1, data), (2, "<nav>menu</nav><p>text</p>"), (3, None), (4, "")], "k int, html string")

    def model(texts, limit):
        assert texts == ["text"]
        return [('[{"title":"b","url":"https://x/2"}]', False)]

    got = {r.k: (r.tier, [j.title for j in r.jobs]) for r in extraction.extract(pages.coalesce(1), model).collect()}
    assert got == {1: (0, ["a"]), 2: (2, ["b"]), 3: (None, []), 4: (None, [])}
    assert [r.tier for r in extraction.extract(pages).orderBy("k").collect()] == [0, None, None, None]


def streamed(spark, folder, batches, schema, build):
    """What a stream over some files, one at a time, appends."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"in/{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in/*"))
    out, state = str(folder / "out"), str(folder / "state")
    q = build(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def test_salvage_stream_drops_late_events(spark, tmp_path):
    from pagelode.streaming.streams import salvage_stream

    schema = "source string, model string, ts string, status string"
    day = [("s", "m", "2026-01-01 00:30:00", "salvaged"), ("s", "m", "2026-01-01 00:40:00", "clean")]
    later = [("s", "m", "2026-01-03 12:00:00", "clean")]
    late = [("s", "m", "2026-01-01 00:50:00", "salvaged"), ("s", "m", "2026-01-06 00:00:00", "clean")]
    between = [("s", "m", "2026-01-03 12:10:00", "clean")]  # an event is late by the watermark of the batch before
    got = streamed(spark, tmp_path, [day, later, between, late], schema, lambda x: salvage_stream(x).select("window.start", "n", "rate"))
    rows = {str(r.start): (r.n, r.rate) for r in got.collect()}
    assert rows["2026-01-01 00:00:00"] == (2, 0.5) and rows["2026-01-03 12:00:00"] == (2, 0.0)


def test_cache_lifetime_and_sessions_are_streams(spark, tmp_path):
    from pagelode.streaming.streams import first_in_lifetime, sessions

    schema = "k string, ts string"
    batches = [[("a", "2026-01-01 00:00:00")], [("a", "2026-01-01 00:20:00"), ("b", "2026-01-01 00:20:00")], [("b", "2026-01-01 09:00:00")], [("a", "2026-01-01 09:30:00")]]
    (tmp_path / "x").mkdir()
    (tmp_path / "y").mkdir()
    kept = streamed(spark, tmp_path / "x", batches, schema, lambda x: first_in_lifetime(x, "k"))
    assert sorted((r.k, str(r.ts)[11:16]) for r in kept.collect()) == [("a", "00:00"), ("a", "09:30"), ("b", "00:20"), ("b", "09:00")]
    spans = streamed(spark, tmp_path / "y", batches, schema, lambda x: sessions(x, "k").select("k", "session_window.start", "n"))
    assert {(r.k, str(r.start)[11:16], r.n) for r in spans.collect()} >= {("a", "00:00", 2), ("b", "00:20", 1)}
