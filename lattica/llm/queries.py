"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpefst, crf, langid, linedel, mixing, pivots, repair, simhash, urlbloom, zdist

END_ID = 2
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.encode_to_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op2_crf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.label_documents(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(_table(spark, sf_dir, "documents"))


def op4_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zdist.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds each canonical URL that two pages or more have."""
    pages = _table(spark, sf_dir, "pages")
    canon = urlbloom.canonical(urlbloom.host(F.col("url")), urlbloom.path(F.col("url")))
    listed = pages.select(canon.alias("canon")).groupBy("canon").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return urlbloom.judge(pages, listed, RULES)


def op6_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents"))


def op7_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedel.summary(_table(spark, sf_dir, "documents"))


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpefst.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_repair_shards, op2_crf_lines, op3_language_id, op4_compression_toxicity, op5_url_filter, op6_systematic_mix, op7_pivot_index, op8_line_dedup, op9_bpe_transducer, op10_simhash_pigeonhole, pipeline)
    return {f.__name__: f for f in own}


def _rules_sql(column: str) -> str:
    longest = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    value = {"rule": lambda r: r[1] + r[2], "verdict": lambda r: r[0]}[column]
    return "CASE " + " ".join(f"WHEN (host = '{r[1]}' OR host LIKE '%.{r[1]}') AND starts_with(path, '{r[2]}') THEN '{value(r)}'" for r in longest) + " END"


OP5 = rf"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '{urlbloom.PARTS}', 1), ''), '{urlbloom.UPPER}', '{urlbloom.LOWER}') AS host,
    coalesce(regexp_extract(url, '{urlbloom.PARTS}', 2), '') AS path
  FROM pages
), named AS (
  SELECT *, regexp_replace(host, '^(www\.|m\.)', '') || regexp_replace(path, '/+$', '') AS canon FROM parts
), listed AS (
  SELECT canon FROM named WHERE canon <> '' GROUP BY canon HAVING count(*) > 1
)
SELECT page_id, host, path, {_rules_sql("rule")} AS rule,
  coalesce({_rules_sql("verdict")}, CASE WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM named
"""

OP6 = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), placed AS (
  SELECT *, source IS NULL AS no_source, coalesce(source, '') AS src, length(bin(size)) AS magnitude,
    md5('mix' || coalesce(doc_id::VARCHAR, '')) AS place FROM sizes
), sources AS (
  SELECT no_source, src, sum(size)::BIGINT AS source_size FROM placed GROUP BY ALL
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1] AS weight, 3.0::DOUBLE * source_size AS cap FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0::DOUBLE)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT no_source, src, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels
), ranked AS (
  SELECT p.doc_id, p.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0::DOUBLE END AS expected,
    row_number() OVER (PARTITION BY p.no_source, p.src ORDER BY p.magnitude, p.place, p.size) AS k,
    ('0x' || substr(md5('mix' || CASE WHEN p.no_source THEN '0' ELSE '1' || p.src END), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift
  FROM placed p JOIN targets t ON p.no_source = t.no_source AND p.src = t.src
)
SELECT doc_id, size, source_size, target, (size * (floor(expected * k + shift) - floor(expected * (k - 1) + shift)))::BIGINT AS taken FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5, "op6_systematic_mix": OP6}
