"""Queries against tables: bind, lower, and shape the result."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from lattica.errors import EXECUTION, EngineError, translated
from lattica.operators import recursion
from lattica.operators.lower import Lowering, leaves, plan_sensitive, settled
from lattica.plans.bind import bind
from lattica.plans.types import Query, Relation


class Engine:
    """``tables`` answers ``get(name)`` with a Table or None and ``frame(name)`` with its rows."""

    def __init__(self, spark: SparkSession, tables, small: int = recursion.SMALL):
        """``small``: see ``recursion``; 0 makes each level of a recursion a Spark job."""
        self.spark, self.tables, self.small = spark, tables, small

    def bind(self, query: dict, published: dict[str, tuple[list, DataFrame]] | None = None) -> Query:
        return bind(query, self.tables, {n: c for n, (c, _) in (published or {}).items()})

    def dataframe(self, query: dict, published: dict[str, tuple[list, DataFrame]] | None = None) -> DataFrame:
        """The root's rows, in order where it has one."""
        return self.lowered(self.bind(query, published), published)

    def lowered(self, bound: Query, published: dict[str, tuple[list, DataFrame]] | None = None) -> DataFrame:
        lowering = Lowering(self.spark, self.tables, {n: df for n, (_, df) in (published or {}).items()})
        relations = [bound.root] + [r for _, b in bound.bindings for r in ([b] if isinstance(b, Relation) else b[1:3])]
        uses: dict[str, int] = {}
        for leaf in (x for r in relations for x in leaves(r)):
            if leaf.kind == "ref":
                uses[leaf.value] = uses.get(leaf.value, 0) + 1
        for name, b in bound.bindings:
            if isinstance(b, Relation):
                df = lowering.plain(b)
                lowering.bindings[name] = settled(df) if uses.get(name, 0) > 1 and plan_sensitive(b) else df
            else:
                lowering.bindings[name] = recursion.evaluate(lowering, name, *b, small=self.small)
        return lowering.root(bound.root)

    def execute(self, query: dict, published: dict[str, tuple[list, DataFrame]] | None = None) -> Any:
        """The result as nested Python data, shaped by the root's cardinality."""
        bound = self.bind(query, published)
        try:
            return shaped(self.lowered(bound, published), bound.cardinality)
        except EngineError:
            raise
        except Exception as error:
            raise translated(error) from error

    def explain(self, query: dict) -> str:
        """The bound tree, one node a line."""
        bound = self.bind(query)
        lines: list[str] = []

        def show(r: Relation, depth: int) -> None:
            high = "many" if r.high is None else r.high
            lines.append(f"{'  ' * depth}{r.kind} rows {r.low}..{high}{' ordered' if r.ordered else ''}{' reads ' + str(sorted(r.free)) if r.free else ''}: {', '.join(c.name for c in r.output)}")
            for x in r.inputs:
                show(x, depth + 1)

        for name, b in bound.bindings:
            lines.append(f"binding {name}")
            for r in [b] if isinstance(b, Relation) else b[1:3]:
                show(r, 1)
        lines.append(f"root {bound.cardinality}")
        show(bound.root, 1)
        return "\n".join(lines)


def datum(value: Any) -> Any:
    if isinstance(value, Row):
        return {k: datum(v) for k, v in zip(value.__fields__, value)}
    return [datum(v) for v in value] if isinstance(value, list) else value


def shaped(df: DataFrame, cardinality: str) -> Any:
    if cardinality == "many":
        return [datum(r) for r in df.collect()]
    found = [datum(r) for r in df.limit(2 if cardinality == "exactly_one" else 1).collect()]
    if cardinality == "exactly_one":
        if len(found) != 1:
            raise EngineError(EXECUTION, "cardinality_violation", f"{'no' if not found else 'more than one'} row")
        return found[0]
    if not found:
        return None
    return found[0] if cardinality == "first" else next(iter(found[0].values()))


def to_json(value: Any) -> str:
    """Compact JSON; a non-finite number is an error."""

    def check(x: Any) -> None:
        if isinstance(x, float) and not math.isfinite(x):
            raise EngineError(EXECUTION, "non_finite_result")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            check(y)

    check(value)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
