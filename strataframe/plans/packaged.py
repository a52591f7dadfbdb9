"""Queries over packages of analysed pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataframe.plans.catalogue import query
from strataframe.plans.lifts import grouped
from strataframe.sources import packages

#: A page's html and address as two artifacts; some are missing, changed, unlisted or named twice, some ledgers are unfit.
ARTIFACTS = "SELECT page_id AS package_id, 'pages/' || page_id || '.html' AS path, coalesce(html, '') || CASE WHEN page_id % 17 = 4 THEN ' ' ELSE '' END AS said FROM {pages} WHERE page_id % 13 <> 5 UNION ALL SELECT page_id, CASE WHEN page_id % 29 = 11 THEN 'other.txt' ELSE 'url.txt' END, coalesce(url, '') FROM {pages}"
ENTRIES = "SELECT page_id AS package_id, CASE WHEN page_id % 19 = 6 THEN '../' ELSE '' END || 'pages/' || page_id || '.html' AS path, {sha_html} AS sha256 FROM {pages} UNION ALL SELECT page_id, 'url.txt', CASE WHEN page_id % 23 = 7 THEN 'none' ELSE {sha_url} END FROM {pages} UNION ALL SELECT page_id, 'url.txt', {sha_url} FROM {pages} WHERE page_id % 31 = 8"
LEDGERS = """SELECT page_id AS package_id, CAST(CASE WHEN page_id % 37 = 9 THEN 3 ELSE 1 + page_id % 2 END AS BIGINT) AS version, CAST(page_id % 41 AS BIGINT) AS width, 600 AS height,
CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '{"a": ["x", {"b": "DATA:image/png;base64,AAAA"}]}' WHEN 2 THEN '{"a": "' || repeat('QUJD', CASE WHEN page_id % 3 = 0 THEN 512 ELSE 511 END) || '"}' WHEN 3 THEN '{"a": ' WHEN 4 THEN '{"data:image/": 1}' ELSE '{"url": "' || replace(coalesce(url, ''), '"', '') || '"}' END AS metadata FROM {pages}"""


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ledgers, entries, artifacts."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    sha = {f"sha_{c}": f"sha2(CAST(coalesce({c}, '') AS BINARY), 256)" for c in ("html", "url")}
    entries = ENTRIES.replace("{sha_html}", sha["sha_html"]).replace("{sha_url}", sha["sha_url"])
    artifacts = spark.sql(ARTIFACTS, pages=pages).selectExpr("package_id", "path", "CAST(said AS BINARY) AS bytes")
    pages.createOrReplaceTempView("strataframe_pages")  # braces of JSON would be taken for parameters
    return spark.sql(LEDGERS.replace("{pages}", "strataframe_pages")), spark.sql(entries, pages=pages), artifacts


_DUCK_ENTRIES = ENTRIES.replace("{pages}", "pages").replace("{sha_html}", "sha256(coalesce(html, ''))").replace("{sha_url}", "sha256(coalesce(url, ''))")
_STRINGS = "list_filter(json_extract_string(metadata, ['$.a[0]', '$.a[1].b', '$.a', '$.url']), lambda s: s IS NOT NULL)"


@query(
    "package_faults",
    grouped(
        f"""WITH art AS MATERIALIZED ({ARTIFACTS.replace("{pages}", "pages")}), ent AS MATERIALIZED ({_DUCK_ENTRIES}), led AS MATERIALIZED ({LEDGERS.replace("{pages}", "pages")}),
two AS (SELECT coalesce(e.package_id, a.package_id) AS package_id, coalesce(e.path, a.path) AS path, e.sha256, sha256(a.said) AS found, e.path IS NOT NULL AS named, a.path IS NOT NULL AS there FROM ent e FULL JOIN art a ON a.package_id = e.package_id AND a.path = e.path),
opened AS (SELECT *, json_valid(metadata) AS fine, CASE WHEN json_valid(metadata) THEN {_STRINGS} END AS strings FROM led)
SELECT package_id, 'version_unsupported' AS fault, NULL AS path FROM led WHERE version NOT IN (1, 2) UNION ALL SELECT package_id, 'canvas_invalid', NULL FROM led WHERE width <= 0
UNION ALL SELECT package_id, 'metadata_no_json', NULL FROM opened WHERE NOT fine UNION ALL SELECT package_id, 'metadata_image', NULL FROM opened WHERE len(list_filter(strings, lambda s: contains(lower(s), 'data:image/'))) > 0
UNION ALL SELECT package_id, 'metadata_opaque', NULL FROM opened WHERE len(list_filter(strings, lambda s: length(s) >= 2048 AND regexp_full_match(s, '[A-Za-z0-9+/]+={{0,2}}'))) > 0
UNION ALL SELECT package_id, 'path_repeated', path FROM ent GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT DISTINCT package_id, 'path_unsafe', path FROM ent WHERE starts_with(path, '../')
UNION ALL SELECT DISTINCT package_id, 'digest_malformed', path FROM ent WHERE length(sha256) <> 64 UNION ALL SELECT DISTINCT package_id, 'artifact_missing', path FROM two WHERE NOT there
UNION ALL SELECT DISTINCT package_id, 'artifact_unlisted', path FROM two WHERE NOT named UNION ALL SELECT DISTINCT package_id, 'digest_mismatch', path FROM two WHERE named AND there AND sha256 <> found"""
    ),
)
def package_faults(spark, d):
    return packages.faults(*_tables(spark, d))
