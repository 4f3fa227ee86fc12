"""Mixing sources to target weights by systematic sampling (operator 6), in
DataFrame functions alone.

Each source gets a target; each of its documents is expected
target / size times.  Documents stand in a fixed order; the expected copies
are summed along it, one random offset is added, and a document is emitted
once for each integer that the sum crosses at it.

The order within a source is by magnitude of size, then by hash of the id, so
that the words taken come near the target.  A sum along a source of any size
needs no single task: hash prefixes split each magnitude into 4,096 stretches;
sums over whole stretches come from a table of counts, and only places inside
a stretch are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3.0
WEIGHTS = (5.0, 2.0, 1.0)
_STRETCH = ["no_source", "src", "magnitude", "stretch"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(id_: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))


def placed(df: DataFrame, id_col: str, size: Column, source_col: str, seed: str) -> DataFrame:
    """``df`` with the columns that order it: source, size, magnitude, hash and stretch."""
    return df.withColumns({
        "size": size,
        "no_source": F.col(source_col).isNull(),
        "src": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        "place": _hash(F.col(id_col), seed),
    }).withColumns({"magnitude": F.length(F.bin("size")), "stretch": F.substring("place", 1, 3)})


def targets(stretches: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Each source's size and target: shares by weight, none above ``MOST`` times
    its size, what that leaves over shared again by weight among the others.

    With sources ordered by cap over weight, the level that fills them is the
    largest of (what is left after the caps so far) / (weights from here on).
    One row per source goes through the ordering."""
    sources = stretches.groupBy("no_source", "src").agg(F.sum("words").alias("source_size"))
    order = F.row_number().over(Window.orderBy("no_source", "src")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.lit(MOST) * F.col("source_size"))
    along = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "src")
    before, whole = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    sources = sources.withColumn("level", left / open_)
    sources = sources.withColumn("target", F.least("cap", F.max("level").over(whole) * F.col("weight")))
    return sources.select("no_source", "src", "source_size", "target")


def copies(rows: DataFrame, narrow: DataFrame, seed: str, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``rows`` (see ``placed``) with source_size, target and copies.

    ``narrow`` has the same rows, from a cheap source: it is read for the counts."""
    stretches = narrow.groupBy(*_STRETCH).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    # Sums over whole magnitudes of a source (64 rows at most), then over whole stretches of a magnitude (4,096 at most).
    upto = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    magnitudes = stretches.groupBy(*_STRETCH[:3]).agg(F.sum("n").alias("n")).withColumn("below", upto(*_STRETCH[:3])).drop("n")
    before = stretches.withColumn("within", upto(*_STRETCH)).join(magnitudes.join(targets(stretches, weights), _STRETCH[:2]), _STRETCH[:3])
    before = before.withColumn("before", F.col("below") + F.col("within"))
    rank = F.row_number().over(Window.partitionBy(*_STRETCH).orderBy("place", "size"))
    rows = rows.withColumn("rank", rank).join(before.select(*_STRETCH, "before", "source_size", "target"), _STRETCH)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.when(F.col("no_source"), "0").otherwise(F.concat(F.lit("1"), F.col("src")))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    to = lambda k: F.floor(expected * k + offset)
    k = F.col("before") + F.col("rank")
    return rows.withColumn("copies", (to(k) - to(k - 1)).cast("long"))


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of each document.

    Null and empty texts have size 0 and take 0 words; a null source is a
    source of its own, after all others; ids only order the documents, so
    null and repeated ones do no harm and reruns agree; an empty table gives
    no rows.  The texts are read once, to count their words."""
    sizes = cut(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("words")), "sizes")
    rows = placed(sizes, "doc_id", F.col("words"), "source", seed).drop("words")
    return copies(rows, rows, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself: ``df``'s rows, each as often as it is taken, with ``df``'s columns.

    See ``plan`` for nulls and ties.  Rows travel under names of their own, so
    any column names of ``df`` are kept."""
    kept = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("words"))
    rows = placed(kept, "id", F.col("words"), "source", seed)
    narrow = cut(placed(kept.select("id", "source", "words"), "id", F.col("words"), "source", seed).select(*_STRETCH, "size"), "sizes")
    taken = copies(rows, narrow, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
