"""Queries of the training-data operators, by the names under which the driver runs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripmill.llm import alignment, conversations, decontaminate, htmltext, langid, licenses, mixing, sharding, simhash, sketch, substrings, tokencount, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_fingerprints": sketch.op2_fingerprints,
    "op3_substrings": substrings.op3_substrings,
    "op4_mixing": mixing.op4_mixing,
    "op5_language": langid.op5_language,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_sharding": sharding.op7_sharding,
    "op8_html": htmltext.op8_html,
    "op9_licenses": licenses.op9_licenses,
    "op10_url_filter": urls.op10_url_filter,
    "op11_token_counts": tokencount.op11_token_counts,
    "op12_conversations": conversations.op12_conversations,
    "op13_alignment": alignment.op13_alignment,
}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_RULES = ", ".join(f"('{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for _, rule in urls.RULES)


def texts_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2_fingerprints says of the texts themselves."""
    return sketch.op2_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_mixing aims at."""
    return mixing.op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows and bytes op7_sharding puts into all shards, and whether the slots of each are gapless."""
    per = sharding.op7_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("slots"))
    return per.agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.bool_and((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("slots") == F.col("n"))).alias("gapless"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_url_filter decides by its list."""
    return urls.op10_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("listed"))


#: Columns of the operators that SQL can express, as queries of their own.
QUERIES |= {"texts_edited": texts_edited, "mixing_targets": mixing_targets, "shard_rows": shard_rows, "url_rules": url_rules}

ORACLE_SQL: dict[str, str] = {
    "texts_edited": """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next FROM t)
SELECT doc_id, n AS n_chars, sha256(left(text, n - n // 2) || left(next, n // 2)) AS edited_sha256 FROM n""",
    # a source is full if, at the unit that all sources full before it leave, its weight asks for more than it may give
    "mixing_targets": f"""WITH d AS (SELECT doc_id, source, {_WORDS} AS size FROM documents), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS w, (SELECT sum(n) FROM s) * 1.5::DOUBLE AS total FROM s),
o AS (SELECT *, 2 * n / w AS full_at, coalesce(sum(2 * n) OVER (ORDER BY 2 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given, sum(w) OVER (ORDER BY 2 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
u AS (SELECT min_by((total - given) / rest, full_at) FILTER (full_at >= (total - given) / rest) AS unit FROM o)
SELECT doc_id, size, n AS source_size, round(least(2.0::DOUBLE * n, w * coalesce(unit, 1e300)), 4) AS target FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, u""",
    "shard_rows": "SELECT count(*) AS n, CAST(sum(octet_length(encode(coalesce(text, ''))) + 8) AS BIGINT) AS size, true AS gapless FROM documents",
    "url_rules": f"""WITH r(rule, host, path) AS (VALUES {_RULES}), p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
f AS (SELECT p.page_id, p.host, p.path, max_by(r.rule, length(r.rule)) AS rule FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY ALL)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{rule}' THEN '{says}'" for says, rule in urls.RULES)} END AS listed FROM f""",
}
