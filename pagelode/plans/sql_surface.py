"""The engine in SQL alone: functions and table functions on a session, and views over the tables.

Functions with a body are SQL that Spark inlines into the query's plan, so nothing is called row by row; what is no expression of SQL
is a table function that runs in Python. Values come from the same rules as the expressions of the library."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from pagelode import rules
from pagelode.functions.shipping import ship_package
from pagelode.functions.text import SPACE
from pagelode.operators import microdata


def _quoted(text: str) -> str:
    """A raw literal of SQL."""
    return "r'" + text + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_quoted(f'^{SPACE}+|{SPACE}+$')}, '')"


def _cases(column: str, pairs: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} RLIKE {_quoted(pattern)} THEN {value}" for pattern, value in pairs) + f" ELSE {other} END"


def functions() -> dict[str, str]:
    """Name to its definition behind CREATE TEMPORARY FUNCTION."""
    scores = ", ".join(f"IF(url RLIKE {_quoted(p)}, {s}D, 0D)" for s, p in rules.URL_SCORES)
    dom = sorted(range(len(rules.DOM_RULES)), key=lambda i: (-rules.DOM_RULES[i][2], i))
    return {
        "content_hash": f"(html STRING) RETURNS STRING RETURN sha2(trim(regexp_replace(html, {_quoted(SPACE + '+')}, ' ')), 256)",
        "strip_tags": f"(html STRING, by STRING) RETURNS STRING RETURN {_strip(f'regexp_replace(html, {_quoted(rules.TAG)}, by)')}",
        "provider_of_url": "(url STRING) RETURNS STRING RETURN " + _cases("url", [(p, f"'{name}'") for name, p, _ in rules.URL_RULES], "'unknown'"),
        "provider_of_page": "(html STRING) RETURNS STRING RETURN " + _cases("html", [(rules.DOM_RULES[i][1], f"'{rules.DOM_RULES[i][0]}'") for i in dom], "'unknown'"),
        "url_score": f"(url STRING) RETURNS DOUBLE RETURN greatest(0D, {scores})",
        "challenge_reason": "(status INT, body STRING) RETURNS STRING RETURN CASE WHEN status = 403 THEN 'http_403' WHEN "
        + " OR ".join(f"contains(lower(coalesce(body, '')), {_quoted(m)})" for m in rules.CHALLENGE_MARKS)
        + " THEN 'cloudflare_challenge_body' END",
        # One row for each parse event: the rolling day of its source, as audit.salvage_rates_split() finds it from seconds and whole hours.
        "salvage_rates": """() RETURNS TABLE(event_id BIGINT, source STRING, model STRING, status STRING, n BIGINT, rate DOUBLE) RETURN
            WITH seconds AS (SELECT source, model, unix_seconds(ts) AS t, floor(unix_seconds(ts) / 3600) AS h, count(*) AS n, count_if(coalesce(status = 'salvaged', false)) AS s
                FROM parse_events GROUP BY source, model, unix_seconds(ts)),
            hours AS (SELECT source, model, h, sum(sum(n)) OVER day AS n, sum(sum(s)) OVER day AS s FROM seconds WHERE t IS NOT NULL GROUP BY source, model, h
                WINDOW day AS (PARTITION BY source, model ORDER BY h RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING)),
            moves AS (SELECT source, model, h, t, n, s, true AS come FROM seconds
                UNION ALL SELECT source, model, h + 24, t + 86400, n, s, false FROM seconds WHERE t IS NOT NULL),
            here AS (SELECT source, model, h, t, come, sum(IF(come, n, 0)) OVER up_to - coalesce(sum(IF(come, 0, n)) OVER past, 0) AS n,
                sum(IF(come, s, 0)) OVER up_to - coalesce(sum(IF(come, 0, s)) OVER past, 0) AS s FROM moves
                WINDOW up_to AS (PARTITION BY source, model, h ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                past AS (PARTITION BY source, model, h ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            rated AS (SELECT x.source, x.model, x.t, x.n + coalesce(b.n, 0) AS n, (x.s + coalesce(b.s, 0)) / (x.n + coalesce(b.n, 0)) AS rate FROM here x
                LEFT JOIN hours b ON x.source <=> b.source AND x.model <=> b.model AND x.h = b.h WHERE x.come)
            SELECT e.event_id, e.source, e.model, e.status, r.n, r.rate FROM parse_events e
            JOIN rated r ON e.source <=> r.source AND e.model <=> r.model AND unix_seconds(e.ts) <=> r.t""",
    }


@udtf(returnType="item int, owner int, via string, type string, name string, value string")
class MicrodataItems:
    """Properties of a page's microdata items: SELECT ... FROM pages, LATERAL microdata(html)."""

    def eval(self, html: str) -> Iterator[tuple]:
        for item in microdata.items_of(html) if html and "itemscope" in html.lower() else []:
            for p in item["properties"]:
                if p["value"] is not None:
                    yield item["item"], item["owner"], item["via"], (item["types"] or [None])[0], p["name"], p["value"]


def register(spark: SparkSession, folder: str | None = None) -> list[str]:
    """Puts the functions on a session, and the tables of a folder (of Parquet) as views; the names that it has put there."""
    ship_package(spark)
    if folder:
        for name in ("pages", "events", "documents", "customer", "orders"):
            spark.read.parquet(os.path.join(folder, f"{name}.parquet")).createOrReplaceTempView(name)
        spark.sql(
            "CREATE OR REPLACE TEMPORARY VIEW parse_events AS SELECT event_id, concat('s', user_id % 20) AS source, 'm' AS model, CAST(ts AS TIMESTAMP) AS ts, "
            "CASE event_type WHEN 'error' THEN 'salvaged' WHEN 'signup' THEN 'truncated' WHEN 'view' THEN 'failed' ELSE 'clean' END AS status FROM events"
        )
    put = []
    for name, body in functions().items():
        if name != "salvage_rates" or folder:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
            put.append(name)
    spark.udtf.register("microdata", MicrodataItems)
    return [*put, "microdata"]
