"""A small vocabulary that writes query graphs: nested relations in, the wire form out."""

from __future__ import annotations

from typing import Any

KINDS = {bool: "bool", int: "int64", float: "float64", str: "text"}


class Rel(dict):
    """A relation node whose inputs are nested nodes."""


def scan(table: str, scope: str | None = None) -> Rel:
    return Rel(kind="scan", table=table, scope=scope or table)


def rows(scope: str, columns: dict[str, str], data: list[tuple]) -> Rel:
    """Columns as name: type, with ``?`` after the type where null is allowed."""
    cell = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, float) else str(v)
    return Rel(kind="rows", scope=scope, columns=[{"name": n, "type": t.rstrip("?"), "nullable": t.endswith("?")} for n, t in columns.items()], rows=[[cell(v) for v in r] for r in data])


def ref(binding: str, scope: str | None = None) -> Rel:
    return Rel(kind="ref", binding=binding, scope=scope or binding)


def recursive_ref(binding: str, scope: str | None = None) -> Rel:
    return Rel(kind="recursive_ref", binding=binding, scope=scope or binding)


def where(of: Rel, predicate: dict) -> Rel:
    return Rel(kind="filter", input=of, predicate=predicate)


def project(of: Rel, spread: list[str] | None = None, scope: str | None = None, **fields: Any) -> Rel:
    out = Rel(kind="project", input=of)
    if scope:
        out["scope"] = scope
    if spread:
        out["spread"] = spread
    if fields:
        out["fields"] = [{"as": n, "expr": expr(e)} for n, e in fields.items()]
    return out


def join(left: Rel, right: Rel, on: Any, how: str = "inner") -> Rel:
    return Rel(kind="join", left=left, right=right, join=how, on=expr(on))


def concatenate(scope: str, *inputs: Rel) -> Rel:
    return Rel(kind="concatenate", inputs=list(inputs), scope=scope)


def intersect(scope: str, left: Rel, right: Rel, quantifier: str = "distinct") -> Rel:
    return Rel(kind="intersect", left=left, right=right, quantifier=quantifier, scope=scope)


def except_(scope: str, left: Rel, right: Rel, quantifier: str = "distinct") -> Rel:
    return Rel(kind="except", left=left, right=right, quantifier=quantifier, scope=scope)


def aggregate(of: Rel, groups: dict[str, Any] | None = None, scope: str | None = None, **aggs: Any) -> Rel:
    """Aggregates as name=(function, argument); ``count`` needs no argument."""
    out = Rel(kind="aggregate", input=of)
    if scope:
        out["scope"] = scope
    if groups:
        out["groups"] = [{"as": n, "expr": expr(e)} for n, e in groups.items()]
    if aggs:
        out["aggs"] = [{"fn": a[0], "as": n, **({"arg": expr(a[1])} if len(a) > 1 else {})} for n, a in ((n, a if isinstance(a, tuple) else (a,)) for n, a in aggs.items())]
    return out


def order(of: Rel, *terms: Any) -> Rel:
    """Terms are expressions, or (expression, True) for descending ones."""
    return Rel(kind="order", input=of, terms=[{"expr": expr(t[0]), "desc": t[1]} if isinstance(t, tuple) else {"expr": expr(t)} for t in terms])


def slice_(of: Rel, limit: int | None = None, offset: int = 0) -> Rel:
    out = Rel(kind="slice", input=of, offset=offset)
    if limit is not None:
        out["limit"] = limit
    return out


def distinct(of: Rel) -> Rel:
    return Rel(kind="distinct", input=of)


def expr(value: Any) -> dict:
    """``scope.column`` strings that start with ``@`` are columns, dicts stand, all else is a literal."""
    if isinstance(value, dict):
        return value
    if isinstance(value, str) and value.startswith("@"):
        return col(*value[1:].split(".", 1))
    return lit(value)


def col(scope: str, column: str) -> dict:
    return {"kind": "col", "scope": scope, "column": column}


def lit(value: Any, kind: str | None = None) -> dict:
    kind = kind or KINDS[type(value)]
    return {"kind": "lit", "value": {"type": kind} if value is None else {"type": kind, "value": value if isinstance(value, (bool, str)) else repr(value)}}


def null(kind: str) -> dict:
    return lit(None, kind)


def binary(op: str, left: Any, right: Any) -> dict:
    return {"kind": "binary", "op": op, "left": expr(left), "right": expr(right)}


def _binary(op: str):
    return lambda left, right: binary(op, left, right)


eq, ne, lt, lte, gt, gte = map(_binary, ("eq", "ne", "lt", "lte", "gt", "gte"))
add, sub, mul, div = map(_binary, ("add", "sub", "mul", "div"))


def and_(first: Any, *others: Any) -> dict:
    out = expr(first)
    for x in others:
        out = binary("and", out, x)
    return out


def or_(first: Any, *others: Any) -> dict:
    out = expr(first)
    for x in others:
        out = binary("or", out, x)
    return out


def unary(op: str, value: Any) -> dict:
    return {"kind": "unary", "op": op, "expr": expr(value)}


def not_(value: Any) -> dict:
    return unary("not", value)


def negate(value: Any) -> dict:
    return unary("negate", value)


def is_null(value: Any) -> dict:
    return unary("is_null", value)


def is_not_null(value: Any) -> dict:
    return unary("is_not_null", value)


def cast(value: Any, to: str) -> dict:
    return {"kind": "cast", "expr": expr(value), "to": to}


def branch(*arms: tuple[Any, Any], otherwise: Any) -> dict:
    return {"kind": "branch", "branches": [{"when": expr(w), "then": expr(t)} for w, t in arms], "else": expr(otherwise)}


def match(value: Any, pattern: str, fold: bool = False) -> dict:
    """``*`` in the pattern stands for any characters."""
    parts: list[dict] = []
    for i, piece in enumerate(pattern.split("*")):
        parts += [{"kind": "any_many"}] * (i > 0) + [{"kind": "literal", "value": piece}] * bool(piece)
    out = {"kind": "text_match", "value": expr(value), "parts": parts}
    return out | {"comparison": "unicode_simple_fold"} if fold else out


def exists(of: Rel) -> dict:
    return {"kind": "exists", "node": of}


def first(of: Rel) -> dict:
    return {"kind": "first", "node": of}


def scalar(of: Rel) -> dict:
    return {"kind": "scalar", "node": of}


def array(of: Rel) -> dict:
    return {"kind": "array", "node": of}


def query(root: Rel, cardinality: str = "many", **bindings: Any) -> dict:
    """The wire form.  A binding is a relation, or (anchor, step, ``all`` or ``new``)."""
    nodes: dict[str, dict] = {}

    def flat(value: Any) -> Any:
        if isinstance(value, Rel):
            made = {k: flat(v) for k, v in value.items()}
            id_ = f"n{len(nodes)}"
            nodes[id_] = made
            return id_
        if isinstance(value, dict):
            return {k: flat(v) for k, v in value.items()}
        return [flat(v) for v in value] if isinstance(value, list) else value

    wire: dict[str, dict] = {}
    for name, b in bindings.items():
        wire[name] = {"kind": "recursive", "anchor": flat(b[0]), "step": flat(b[1]), "accumulation": b[2]} if isinstance(b, tuple) else {"kind": "derived", "node": flat(b)}
    out = {"nodes": nodes, "root": {"node": flat(root), "cardinality": cardinality}}
    return out | {"bindings": wire} if wire else out
