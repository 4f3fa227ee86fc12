"""Recursive bindings: semi-naive levels until nothing new appears.

Levels run on Spark, each written to the shared folder.  While everything the
step reads is small (its leaf tables, the frontier and what was found so far,
up to ``SMALL`` rows each, checked by reading one row more), the levels run in
the interpreter on the driver instead, because a job for each level of a deep
chain would take most of the time.  The bound does not change results: beyond
it the same levels go on as Spark jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import EXECUTION, EngineError
from lattica.operators.interpret import Interpreter, identity
from lattica.operators.lower import Lowering, leaves, rows_frame
from lattica.plans.types import Relation, Type
from lattica.sources.shared import cut

SMALL = 20_000
MOST_LEVELS, MOST_ROWS = 10_000, 1_000_000


def _limit(ok: bool, what: str) -> None:
    if not ok:
        raise EngineError(EXECUTION, "recursion_limit", what)


def _small_rows(df: DataFrame, small: int) -> list[tuple] | None:
    if not small:
        return None
    found = df.limit(small + 1).collect()
    return None if len(found) > small else [tuple(r) for r in found]


def evaluate(lowering: Lowering, name: str, mode: str, anchor: Relation, step: Relation, columns: list[tuple[str, Type]], most_levels: int = MOST_LEVELS, most_rows: int = MOST_ROWS, small: int | None = None) -> DataFrame:
    """The binding's rows, columns c0, c1, ... in the anchor's order."""
    spark, small = lowering.spark, SMALL if small is None else small
    names = [f"c{i}" for i in range(len(columns))]
    types = [t for _, t in columns]
    at = {c.name: i for i, c in enumerate(step.output)}
    places = [at[n] for n, _ in columns]  # step columns are matched by name
    start = lowering.plain(anchor)
    rows = _small_rows(start, small)
    inner = rows is not None and _interpreter(lowering, step, small)
    if not inner:
        return _on_spark(lowering, name, mode, start.select(*(F.col(c).alias(n) for c, n in zip(start.columns, names))), step, names, places, None, 0, most_levels, most_rows)

    def fresh(found: list[tuple]) -> list[tuple]:
        if mode == "all":
            return found
        out = []
        for t in found:
            key = identity(list(t))
            if key not in seen:
                seen.add(key)
                out.append(t)
        return out

    seen: set = set()
    frontier = fresh(rows)
    everything = list(frontier)
    level = 0
    while frontier:
        _limit(level < most_levels, f"{name}: levels")
        if len(frontier) > small or len(everything) > 5 * small:
            return _on_spark(lowering, name, mode, rows_frame(spark, names, types, frontier), step, names, places, rows_frame(spark, names, types, everything), level, most_levels, most_rows)
        inner.frontier[name] = frontier
        frontier = fresh([tuple(t[p] for p in places) for t in inner._tuples(step, {})])
        everything += frontier
        _limit(len(everything) <= most_rows, f"{name}: rows")
        level += 1
    return rows_frame(spark, names, types, everything)


def _interpreter(lowering: Lowering, step: Relation, small: int) -> Interpreter | None:
    """An interpreter that holds the step's leaf tables, if all are small."""
    tables: dict[str, list[tuple]] = {}
    bindings: dict[str, list[tuple]] = {}
    for leaf in leaves(step):
        if leaf.kind == "scan" and leaf.value.name not in tables:
            found = _small_rows(lowering.tables.frame(leaf.value.name).select(*(f"`{c.name}`" for c in leaf.value.columns)), small)
            if found is None:
                return None
            tables[leaf.value.name] = found
        elif leaf.kind == "ref" and leaf.value not in bindings:
            found = _small_rows(lowering.bindings[leaf.value], small)
            if found is None:
                return None
            bindings[leaf.value] = found
    return Interpreter(tables, bindings)


def _on_spark(lowering: Lowering, name: str, mode: str, frontier: DataFrame, step: Relation, names: list[str], places: list[int], found: DataFrame | None, level: int, most_levels: int, most_rows: int) -> DataFrame:
    """Levels as jobs; ``found`` holds what an earlier part has found, the frontier included."""
    if found is None:
        frontier = cut(frontier.distinct() if mode == "new" else frontier, "level")
        found = frontier
    else:
        frontier, found = cut(frontier, "level"), cut(found, "found")
    parts, total = [found], found.count()
    while True:
        if frontier.isEmpty():
            break
        _limit(level < most_levels, f"{name}: levels")
        lowering.frontier[name] = frontier
        stepped = lowering.plain(step)
        stepped = stepped.select(*(F.col(stepped.columns[p]).alias(n) for p, n in zip(places, names)))
        if mode == "new":
            known = parts[0]
            for p in parts[1:]:
                known = known.unionAll(p)
            stepped = stepped.distinct().subtract(known)
        frontier = cut(stepped, "level")
        total += frontier.count()
        _limit(total <= most_rows, f"{name}: rows")
        parts.append(frontier)
        if len(parts) > 16:  # keep plans short
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionAll(p)
            parts = [cut(whole, "found")]
        level += 1
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole
