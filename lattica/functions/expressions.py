"""Bound expressions as Columns, with exact integer, float and three-valued rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.errors import OVERFLOW_TAG
from lattica.functions.fold import fold, table
from lattica.plans.types import FLOAT, INT, SPARK, Expr

_COMPARE = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__", "and": "__and__", "or": "__or__"}


def slot(n: int) -> str:
    return f"s{n}"


def crossed(n: int) -> str:
    return f"x{n}"


def finite(value: Column) -> Column:
    """The value; an error if it is infinite or not a number."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit(OVERFLOW_TAG)).cast("double")).otherwise(value)


def to_int(value: Column) -> Column:
    out_of_range = F.isnan(value) | (value >= F.lit(9223372036854775808.0)) | (value < F.lit(-9223372036854775808.0))
    return F.when(out_of_range, F.raise_error(F.lit(OVERFLOW_TAG)).cast("bigint")).otherwise(value.cast("bigint"))


def like(parts: list[str | None]) -> str:
    return "".join("%" if p is None else "".join("\\" + c if c in "\\%_" else c for c in p) for p in parts)


def lower(e: Expr) -> Column:
    if e.op == "lit":
        return F.lit(e.value).cast(SPARK[e.type.kind])
    if e.op == "col":
        return F.col(slot(e.value))
    if e.op == "crossing":
        return F.col(crossed(e.value))
    args = [lower(a) for a in e.args]
    if e.op in _COMPARE:
        return getattr(args[0], _COMPARE[e.op])(args[1])
    if e.op == "not":
        return ~args[0]
    if e.op == "negate":
        return -args[0]
    if e.op == "is_null":
        return args[0].isNull()
    if e.op == "is_not_null":
        return args[0].isNotNull()
    if e.op in ("add", "sub", "mul", "div"):
        return _arithmetic(e, args)
    if e.op == "cast":
        before, after = e.args[0].type.kind, e.type.kind
        return args[0] if before == after else args[0].cast("double") if after == FLOAT else to_int(args[0])
    if e.op == "branch":
        out = args[-1]
        for when, then in reversed(list(zip(args[:-1:2], args[1:-1:2]))):
            out = F.when(when, then).otherwise(out)
        return out
    parts, how = e.value
    if how == "unicode_simple_fold":
        return F.translate(args[0], *table()).like(like([None if p is None else fold(p) for p in parts]))
    return args[0].like(like(parts))


def _arithmetic(e: Expr, args: list[Column]) -> Column:
    a, b = args
    if e.type.kind == INT:
        if e.op == "div":
            return F.call_function("div", a, b)
        return {"add": a + b, "sub": a - b, "mul": a * b}[e.op]
    a, b = a.cast("double"), b.cast("double")
    return finite({"add": a + b, "sub": a - b, "mul": a * b, "div": a / b}[e.op])


def aggregate(fn: str, arg: Column | None, kind: str | None) -> Column:
    if fn == "count":
        return F.count(F.lit(1) if arg is None else arg)
    if fn == "sum":
        # An exact sum: only the total has to fit.
        return F.sum(arg.cast("decimal(38,0)")).cast("bigint") if kind == INT else finite(F.sum(arg))
    if fn == "avg":
        return finite(F.avg(arg.cast("double")))
    return F.min(arg) if fn == "min" else F.max(arg)
