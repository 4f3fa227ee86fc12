"""Bound relations as DataFrames.

Columns are named by slot, so equal names never clash.  An order is carried
as hidden key columns and applied only where it can be seen.  A correlated
sub-relation is lowered under a domain, the distinct values of the outer slots
that it reads, so that it runs once as a set and is joined back.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import expressions as X
from lattica.functions.expressions import crossed, slot
from lattica.plans.types import ARRAY, ROW, SPARK, Crossing, Expr, Relation, Type
from lattica.sources.shared import cut


@dataclass
class Frame:
    df: DataFrame
    order: list[tuple[str, bool]] = field(default_factory=list)

    def keys(self) -> list[Column]:
        return [F.desc_nulls_last(c) if desc else F.asc_nulls_first(c) for c, desc in self.order]


def ddl(t: Type) -> str:
    if t.kind in (ROW, ARRAY):
        row = "struct<" + ",".join(f"`{n}`:{ddl(x)}" for n, x in t.fields) + ">"
        return row if t.kind == ROW else f"array<{row}>"
    return SPARK[t.kind]


def rows_frame(spark: SparkSession, names: list[str], types: list[Type], data: list[tuple]) -> DataFrame:
    return spark.createDataFrame(data, ", ".join(f"`{n}` {ddl(t)}" for n, t in zip(names, types)))


class Lowering:
    def __init__(self, spark: SparkSession, tables, bindings: dict[str, DataFrame]):
        """``bindings`` hold DataFrames whose columns stand in the order of the binding's."""
        self.spark, self.tables, self.bindings = spark, tables, bindings
        self.frontier: dict[str, DataFrame] = {}
        self.hidden = itertools.count()

    def root(self, r: Relation) -> DataFrame:
        frame = self.lower(r)
        df = frame.df.orderBy(*frame.keys()) if frame.order else frame.df
        return df.select(*(F.col(slot(c.slot)).alias(c.name) for c in r.output))

    def plain(self, r: Relation) -> DataFrame:
        """The rows without an order, columns in place."""
        return self.lower(r).df.select(*(F.col(slot(c.slot)).alias(f"c{i}") for i, c in enumerate(r.output)))

    def lower(self, r: Relation, domain: DataFrame | None = None, outer: tuple[int, ...] = ()) -> Frame:
        return getattr(self, f"_{r.kind}")(r, domain, outer)

    # -- leaves ------------------------------------------------------------------------------------

    def _leaf(self, r: Relation, df: DataFrame, domain: DataFrame | None) -> Frame:
        named = df.select(*(F.col(f"`{n}`").alias(slot(c.slot)) for n, c in zip(df.columns, r.output)))
        return Frame(named if domain is None else domain.crossJoin(named))  # the filter above makes it an equi-join

    def _scan(self, r, domain, outer):
        return self._leaf(r, self.tables.frame(r.value.name).select(*(f"`{c.name}`" for c in r.value.columns)), domain)

    def _rows(self, r, domain, outer):
        return self._leaf(r, rows_frame(self.spark, [f"c{i}" for i in range(len(r.output))], [c.type for c in r.output], r.value), domain)

    def _ref(self, r, domain, outer):
        return self._leaf(r, self.bindings[r.value], domain)

    def _recursive_ref(self, r, domain, outer):
        return self._leaf(r, self.frontier[r.value], domain)

    # -- one input ---------------------------------------------------------------------------------

    def _attached(self, frame: Frame, exprs: list[Expr]) -> Frame:
        """The frame with a column for each crossing in the expressions."""
        df = frame.df
        for c in (c for e in exprs for c in e.crossings):
            df = self._attach(df, c)
        return Frame(df, frame.order)

    def _attach(self, df: DataFrame, c: Crossing) -> DataFrame:
        reads = tuple(sorted(c.relation.free))
        names = [slot(s) for s in reads]
        if not reads:
            return df.crossJoin(F.broadcast(self._collapsed(c, self.lower(c.relation), ())))  # one row
        domain = df.select(*names).distinct()
        found = self._collapsed(c, self.lower(c.relation, domain, reads), reads)
        keys = {n: f"k{next(self.hidden)}" for n in names}
        found = found.select(*(F.col(n).alias(k) for n, k in keys.items()), crossed(c.id))
        on = [F.col(n).eqNullSafe(F.col(k)) for n, k in keys.items()]
        out = df.join(found, [x for x in [_all(on)]], "left").drop(*keys.values())
        if c.kind == "exists":
            return out.withColumn(crossed(c.id), F.coalesce(crossed(c.id), F.lit(False)))
        if c.kind == "array":
            return out.withColumn(crossed(c.id), F.coalesce(crossed(c.id), F.array().cast(ddl(c.type))))
        return out

    def _collapsed(self, c: Crossing, frame: Frame, reads: tuple[int, ...]) -> DataFrame:
        """One row for each value of the outer slots (one row without any), with the crossing's datum."""
        names, out, df = [slot(s) for s in reads], crossed(c.id), frame.df
        if c.kind == "exists":
            return df.select(*names).distinct().withColumn(out, F.lit(True)) if reads else df.limit(1).agg((F.count(F.lit(1)) > 0).alias(out))
        if c.kind == "scalar":
            value = F.col(slot(c.relation.output[0].slot)).alias(out)
            return df.select(*names, value) if reads else df.agg(F.first(value).alias(out))
        payload = F.struct(*(F.col(slot(x.slot)).alias(x.name) for x in c.relation.output))
        if c.kind == "first":
            if not reads:
                return (df.orderBy(*frame.keys()) if frame.order else df).limit(1).agg(F.first(payload).alias(out))
            rank = F.row_number().over(Window.partitionBy(*names).orderBy(*(frame.keys() or [F.lit(1)])))
            return df.select(*names, payload.alias(out), rank.alias("__r")).where("__r = 1").drop("__r")
        rank = F.row_number().over(Window.partitionBy(*names).orderBy(*frame.keys()))
        ranked = df.select(*names, F.struct(rank.alias("r"), payload.alias("p")).alias("__p"))
        listed = F.transform(F.sort_array(F.collect_list("__p"), True), lambda x: x["p"])
        return ranked.groupBy(*names).agg(listed.alias(out))

    def _filter(self, r, domain, outer):
        frame = self._attached(self.lower(r.inputs[0], domain, outer), [r.value])
        return Frame(frame.df.where(X.lower(r.value)), frame.order)

    def _project(self, r, domain, outer):
        frame = self._attached(self.lower(r.inputs[0], domain, outer), [e for _, e in r.value])
        made = {slot(s): F.col(slot(s)) for s in outer} | {c: F.col(c) for c, _ in frame.order}
        computed = {slot(s): X.lower(e) for s, e in r.value}
        for c in r.output:
            made[slot(c.slot)] = computed.get(slot(c.slot), F.col(slot(c.slot)))
        # Keys that only identify a row stay for orders above.
        for s in r.key or ():
            made.setdefault(slot(s), F.col(slot(s)))
        return Frame(frame.df.select(*(e.alias(n) for n, e in made.items())), frame.order)

    def _aggregate(self, r, domain, outer):
        groups, aggs = r.value
        exprs = [e for _, e in groups] + [a for _, _, a in aggs if a is not None]
        df = self._attached(self.lower(r.inputs[0], domain, outer), exprs).df
        over = [slot(s) for s in outer]
        keys = [slot(c.slot) for c, _ in groups]
        args = [X.lower(a).alias(f"__a{i}") for i, (_, _, a) in enumerate(aggs) if a is not None]
        df = df.select(*over, *(X.lower(e).alias(slot(c.slot)) for c, e in groups), *args)
        terms = [X.aggregate(fn, None if a is None else F.col(f"__a{i}"), None if a is None else a.type.kind).alias(slot(c.slot)) for i, (c, fn, a) in enumerate(aggs)]
        if not terms:
            return Frame(df.distinct())
        if not over and not keys:
            return Frame(df.agg(*terms))
        out = df.groupBy(*over, *keys).agg(*terms)
        if domain is not None and not groups:
            # One row for each value of the domain, also where nothing matched.
            renamed = {n: f"k{next(self.hidden)}" for n in over}
            out = out.withColumnsRenamed(renamed)
            out = domain.select(*over).join(out, _all([F.col(n).eqNullSafe(F.col(k)) for n, k in renamed.items()]), "left").drop(*renamed.values())
            out = out.withColumns({slot(c.slot): F.coalesce(slot(c.slot), F.lit(0).cast("bigint")) for c, fn, _ in aggs if fn == "count"} or {})
        return Frame(out)

    def _order(self, r, domain, outer):
        terms, ties = r.value
        frame = self._attached(self.lower(r.inputs[0], domain, outer), [e for e, _ in terms])
        made, order = {}, []
        for value, desc in [(X.lower(e), desc) for e, desc in terms] + [(F.col(slot(s)), False) for s in ties]:
            name = f"o{next(self.hidden)}"
            made[name] = value
            order.append((name, desc))
        return Frame(frame.df.withColumns(made), order + frame.order)

    def _slice(self, r, domain, outer):
        offset, limit = r.value
        frame = self.lower(r.inputs[0], domain, outer)
        if not outer:
            df = frame.df.orderBy(*frame.keys()) if frame.order and (offset or limit is not None) else frame.df
            df = df.offset(offset) if offset else df
            return Frame(df if limit is None else df.limit(limit), frame.order)
        if not offset and limit is None:
            return frame
        rank = f"r{next(self.hidden)}"
        within = Window.partitionBy(*(slot(s) for s in outer)).orderBy(*(frame.keys() or [F.lit(1)]))
        df = frame.df.withColumn(rank, F.row_number().over(within)).where(F.col(rank) > offset)
        df = df if limit is None else df.where(F.col(rank) <= offset + limit)
        return Frame(df.drop(rank), frame.order)

    def _distinct(self, r, domain, outer):
        df = self.lower(r.inputs[0], domain, outer).df
        names = dict.fromkeys([*(slot(s) for s in outer), *(slot(c.slot) for c in r.output)])
        return Frame(df.select(*names).distinct())

    # -- two inputs --------------------------------------------------------------------------------

    def _join(self, r, domain, outer):
        (left, right), (how, on) = r.inputs, r.value
        reads = set(outer)
        in_right, in_left = bool(right.free & reads), bool(left.free & reads)
        both = domain is not None and in_right and (in_left or how == "left" or bool(on.free & reads))
        left_domain = domain is not None and (in_left or not in_right or both)
        a = self.lower(left, domain if left_domain else None, outer if left_domain else ())
        right_domain = domain is not None and (both or not left_domain)
        b = self.lower(right, domain if right_domain else None, outer if right_domain else ())
        shown = [slot(c.slot) for c in right.output]
        keep = dict.fromkeys([*shown, *(slot(s) for s in right.produced if slot(s) in b.df.columns and slot(s) not in shown)])
        condition = X.lower(on)
        if both:
            renamed = {slot(s): f"k{next(self.hidden)}" for s in outer}
            other = b.df.select(*(F.col(n).alias(k) for n, k in renamed.items()), *keep)
            condition = _all([condition, *(F.col(n).eqNullSafe(F.col(k)) for n, k in renamed.items())])
            return Frame(a.df.join(other, condition, how).drop(*renamed.values()))
        other = b.df.select(*([slot(s) for s in outer] if right_domain else []), *keep)
        return Frame(a.df.join(other, condition, how))

    def _placed(self, r, side, domain, outer) -> DataFrame:
        df = self.lower(side, domain, outer).df
        return df.select(*(slot(s) for s in outer), *(F.col(slot(c.slot)).alias(slot(n.slot)) for c, n in zip(side.output, r.output)))

    def _concatenate(self, r, domain, outer):
        first, *others = [self._placed(r, s, domain, outer) for s in r.inputs]
        for df in others:
            first = first.unionAll(df)
        return Frame(first)

    def _intersect(self, r, domain, outer):
        a, b = (self._placed(r, s, domain, outer) for s in r.inputs)
        return Frame(a.intersectAll(b) if r.value == "all" else a.intersect(b))

    def _except(self, r, domain, outer):
        a, b = (self._placed(r, s, domain, outer) for s in r.inputs)
        return Frame(a.exceptAll(b) if r.value == "all" else a.subtract(b))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def leaves(r: Relation) -> list[Relation]:
    """All leaf relations, those of crossings included."""
    out = [] if r.inputs else [r]
    for x in r.inputs:
        out += leaves(x)
    for e in expressions(r):
        for c in e.crossings:
            out += leaves(c.relation)
    return out


def expressions(r: Relation) -> list[Expr]:
    if r.kind == "filter":
        return [r.value]
    if r.kind == "project":
        return [e for _, e in r.value]
    if r.kind == "join":
        return [r.value[1]]
    if r.kind == "order":
        return [e for e, _ in r.value[0]]
    if r.kind == "aggregate":
        return [e for _, e in r.value[0]] + [a for _, _, a in r.value[1] if a is not None]
    return []


def plan_sensitive(r: Relation) -> bool:
    """Whether running it twice could pick other rows: a slice, first or array inside."""
    inside = [c for e in expressions(r) for c in e.crossings]
    return r.kind == "slice" or any(c.kind in ("first", "array") or plan_sensitive(c.relation) for c in inside) or any(map(plan_sensitive, r.inputs))


def settled(df: DataFrame) -> DataFrame:
    return cut(df, "binding")
