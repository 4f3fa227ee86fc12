"""URL filter (operator 5), in DataFrame functions alone.

Rules on host and path come first.  All other URLs are looked up in a list:
a blocked Bloom filter, one row of eight 64-bit words for each block, lets
possible hits through, and an exact hash join against the list removes the
false positives.  The filter is joined by block, so it is broadcast only
where Spark knows it to be small and dealt out by block otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
WORDS, WORD_BITS = 8, 64


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, path without slashes at its end."""
    return F.concat(F.regexp_replace(host, r"^(www\.|m\.)", ""), F.regexp_replace(path, r"/+$", ""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of the rules (verdict, host, path) that fits, and its verdict; null where none does.

    The rules are a short list that stands in the plan; of equally long ones the first in code point order counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, on, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(on + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _bits(key: str) -> list[Column]:
    """The bit that a key sets in each word of its block."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned({key}, {6 * k}) & 63L as int))") for k in range(WORDS)]


def bloom_filter(keys: DataFrame, n: int, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """The filter of the n keys (column ``canon``), by block, and its number of blocks."""
    blocks = max(1, math.ceil(n * bits_per_key / (WORDS * WORD_BITS)))
    hashed = _hashed(keys, blocks)
    return hashed.groupBy("block").agg(*(F.bit_or(b).alias(f"w{k}") for k, b in enumerate(_bits("h")))), blocks


def _hashed(keys: DataFrame, blocks: int) -> DataFrame:
    return keys.select("canon", F.xxhash64("canon").alias("h"), F.pmod(F.xxhash64("canon", F.lit("block")), F.lit(blocks)).alias("block"))


def possible_hits(keys: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The keys whose bits are all set; all listed keys are among them."""
    passed = F.lit(True)
    for k, bit in enumerate(_bits("h")):
        passed = passed & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    return _hashed(keys, blocks).join(bloom, "block").where(passed).select("canon")


def judge(df: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of each row: the rule's verdict,
    else ``block`` for a listed canonical URL and ``allow`` for any other.

    ``listed`` has a column ``canon``; repeats and empty entries there count
    once and never.  Null URLs and those without ``://`` have an empty host
    and path, fit no rule and are allowed.  Rows repeat as they do in ``df``;
    an empty list allows all; an empty table gives no rows.  Each canonical
    URL is looked up once however many rows have it."""
    pages = df.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    pages = pages.withColumn("canon", canonical(F.col("host"), F.col("path")))
    keys = cut(listed.select("canon").where("canon is not null and canon != ''").distinct(), "listed")
    bloom, blocks = bloom_filter(keys, keys.count())
    asked = pages.select("canon").where("canon != ''").distinct()
    hits = possible_hits(asked, bloom, blocks).join(keys, "canon", "left_semi").withColumn("listed", F.lit(True))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return pages.join(hits, "canon", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
