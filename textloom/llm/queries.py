"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kd_shards, media_columns, neighbours, ngram_join, packing, pfair_mix, quality_mil, secret_scan, suffix_dedup, url_filter
from .common import read

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def vocabulary() -> str:
    """The vocabulary file of op7 and the pipeline; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard_report(read(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.shingle_components(read(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_report(read(spark, sf_dir, "documents"))


def media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op4 on real pages: their ordered pieces of text and references."""
    return media_columns.sequence_report(read(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(read(spark, sf_dir, "documents"), vocabulary())


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mixing_report(read(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark, read(spark, sf_dir, "pages"), URL_RULES)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_report(read(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_kd_sharding": op1_kd_sharding,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_media_columns": op4_media_columns,
    "media_sequences": media_sequences,
    "op5_pfair_mixing": op5_pfair_mixing,
    "op6_url_filters": op6_url_filters,
    "op7_packing": op7_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_secret_scans": op9_secret_scans,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    # Pages have no media; of references they hold those replaced here.
    "media_sequences": r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<script>.*?</script>|<style>.*?</style>', '', 'g'), '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '</?(p|br|div|h1|h2|h3|li|article)( [^>]*)?/?>', chr(1), 'g'), '<[^>]*>', '', 'g') AS h FROM a),
c AS (SELECT page_id, list_filter(list_transform(string_split(h, chr(1)), lambda x: trim(regexp_replace(
    replace(replace(replace(replace(x, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS pieces FROM b)
SELECT page_id, len(pieces) AS items, 0 AS media, array_to_string(pieces, chr(10)) AS text FROM c
""",
    "op6_url_filters": r"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
b AS (SELECT page_id, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM b),
d AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM c),
rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                                ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits AS (SELECT page_id, verdict, h || p AS rule,
                row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS r
         FROM d JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT d.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM d LEFT JOIN fits ON d.page_id = fits.page_id AND r = 1
""",
}
