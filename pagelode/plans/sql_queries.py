"""Engine queries written in SQL alone, on the functions of the SQL surface."""

from __future__ import annotations

from pagelode.plans import sql_surface
from pagelode.plans.registry import query
from pagelode.plans.stream_queries import RATED


@query(r"SELECT page_id, sha256(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS content_hash, length(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '^\s+|\s+$', '', 'g'))::INTEGER AS plain FROM pages")
def sql_content_hash(spark, sf_dir):
    sql_surface.register(spark, sf_dir)
    return spark.sql("SELECT page_id, content_hash(html) AS content_hash, char_length(strip_tags(html, ' ')) AS plain FROM pages")


@query(f"WITH {RATED} SELECT source, status, count(*) AS events, max(n) AS most, sum(CAST(rate > 0.1 AS INTEGER))::BIGINT AS above FROM r GROUP BY source, status")
def sql_salvage_rates(spark, sf_dir):
    sql_surface.register(spark, sf_dir)
    return spark.sql("SELECT source, status, count(*) AS events, max(n) AS most, count_if(rate > 0.1) AS above FROM salvage_rates() GROUP BY source, status")


@query("""WITH u AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'https://boards.greenhouse.io/' WHEN 1 THEN 'https://jobs.lever.co/' WHEN 2 THEN 'https://w.icims.com/' WHEN 3 THEN 'https://x.example/careers/'
 WHEN 4 THEN 'https://a.recruitee.com/' ELSE 'https://x.example/' END || c_custkey AS url FROM customer)
SELECT CASE WHEN url LIKE '%greenhouse%' THEN 'greenhouse' WHEN url LIKE '%lever%' THEN 'lever' WHEN url LIKE '%icims%' THEN 'icims' WHEN url LIKE '%recruitee%' THEN 'recruitee' ELSE 'unknown' END AS provider,
 CASE WHEN url LIKE '%greenhouse%' OR url LIKE '%lever%' THEN 1.0 WHEN url LIKE '%icims%' THEN 0.85 WHEN url LIKE '%/careers%' THEN 0.5 ELSE 0.0 END::DOUBLE AS score, count(*) AS urls FROM u GROUP BY 1, 2""")
def sql_providers(spark, sf_dir):
    sql_surface.register(spark, sf_dir)
    return spark.sql("""WITH u AS (SELECT c_custkey AS k, concat(CASE c_custkey % 6 WHEN 0 THEN 'https://boards.greenhouse.io/' WHEN 1 THEN 'https://jobs.lever.co/' WHEN 2 THEN 'https://w.icims.com/'
 WHEN 3 THEN 'https://x.example/careers/' WHEN 4 THEN 'https://a.recruitee.com/' ELSE 'https://x.example/' END, c_custkey) AS url FROM customer)
SELECT provider_of_url(url) AS provider, url_score(url) AS score, count(*) AS urls FROM u GROUP BY 1, 2""")


@query("""SELECT page_id, 0 AS item, 'Place' AS type, 'name' AS name, 'P' || page_id AS value FROM pages UNION ALL SELECT page_id, 1, 'Geo', 'lat', CAST(page_id % 90 AS VARCHAR) FROM pages""")
def sql_microdata(spark, sf_dir):
    sql_surface.register(spark, sf_dir)
    return spark.sql("""SELECT page_id, item, type, name, value FROM (SELECT page_id, concat('<div itemscope itemtype="Place"><p itemprop="geo" itemscope itemtype="Geo"><meta itemprop="lat" content="', page_id % 90,
 '"></p><b itemprop="name">P', page_id, '</b></div>', html) AS html FROM pages) p, LATERAL microdata(html)""")
