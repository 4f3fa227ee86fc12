"""Atomic programs: ordered statements over a versioned store.

A program reads one manifest.  Its statements see each other's effects; only
when all have passed is one new manifest published.  Constraints are checked
on the state after each statement, as joins and aggregates over whole tables.
"""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.engine import Engine, shaped
from lattica.errors import BIND, CATALOG, CONFLICT, CONSTRAINT, EXECUTION, EngineError, translated
from lattica.plans import types as T
from lattica.plans.bind import bind
from lattica.plans.types import SPARK
from lattica.sources import catalog as C
from lattica.sources.shared import cut
from lattica.sources.store import Snapshot, Store

MUTATIONS = ("create", "update", "delete")
CATALOG_STATEMENTS = ("create_table", "rename_table", "delete_table", "create_column", "rename_column", "change_column_default", "delete_column", "create_index", "delete_index", "start_index_build", "start_column_replacement", "start_constraint_validation")


def _violation(detail: str) -> EngineError:
    return EngineError(CONSTRAINT, "constraint_violation", detail)


class Database:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    def snapshot(self, version: int | None = None) -> Snapshot:
        m = self.store.manifest(version)
        return Snapshot(self.store, m["catalog"], m["data"])

    def query(self, query: dict) -> Any:
        return Engine(self.spark, self.snapshot()).execute(query)

    def execute(self, program: dict, dry_run: bool = False, expected_catalog: str | None = None, allow_catalog: bool = True) -> dict:
        """The selected statement's result, and what each statement affected."""
        before = self.store.manifest()
        if expected_catalog is not None and expected_catalog != C.digest(before["catalog"]):
            raise EngineError(CONFLICT, "catalog_changed", expected_catalog)
        run = _Run(self, before, allow_catalog)
        try:
            out = run.all(program)
        except EngineError:
            raise
        except Exception as error:
            raise translated(error) from error
        if run.effects and not dry_run:
            self.store.publish(before, run.changes.catalog, run.data, run.transitions)
        return out

    # -- transitions -------------------------------------------------------------------------------

    def transitions(self) -> list[dict]:
        """The record of each online change, oldest first.

        A change here is one job that ends with its program, so a record says
        ``completed``; what fails or conflicts leaves none."""
        return list(self.store.manifest().get("transitions", []))

    def transition(self, id_: int) -> dict:
        found = [t for t in self.transitions() if t["id"] == id_]
        if not found:
            raise EngineError(CATALOG, "transition_not_found", str(id_))
        return found[0]

    def cancel_transition(self, id_: int) -> dict:
        """Only a running transition can be cancelled; a completed one is an error."""
        raise EngineError(CATALOG, "transition_not_active", f"{id_}: {self.transition(id_)['state']}")

    # -- migration ---------------------------------------------------------------------------------

    def plan(self, schema: str | dict) -> dict:
        """Steps to a declared schema, and what would be lost or stands in the way."""
        m = self.store.manifest()
        steps = C.difference(m["catalog"], C.parse(schema))
        snapshot = Snapshot(self.store, m["catalog"], m["data"])
        renamed = {s[2]: s[1] for s in steps if s[0] == "rename_table"}
        columns = {(s[1], s[3]): s[2] for s in steps if s[0] == "rename_column"}
        destructive, blocking = [], []
        for s in steps:
            if s[0] in ("delete_table", "delete_column"):
                destructive.append(s)
                continue
            if s[0] not in ("replace_type", "set_nullable", "create_index"):
                continue
            name = renamed.get(s[1], s[1])
            rows = snapshot.frame(name)
            rows = rows.withColumnsRenamed({old: new for (of, new), old in columns.items() if of == s[1]})
            if s[0] == "replace_type":
                t = C.table(m["catalog"], name)
                old = columns.get((s[1], s[2]), s[2])
                value = converted(F.col(f"`{s[2]}`"), C.column(t, old)["type"], s[3])
                if not rows.where(F.col(f"`{s[2]}`").isNotNull() & value.isNull()).isEmpty():
                    blocking.append(("conversion", *s[1:]))
                of = {c["id"]: next((new for (at, new), o in columns.items() if at == s[1] and o == c["name"]), c["name"]) for c in t["columns"]}
                for i in t["indexes"]:
                    names = [of[c] for c in i["columns"]]
                    if i["unique"] and s[2] in names and not _repeated(rows.withColumn(s[2], value), names).isEmpty():
                        blocking.append(("duplicates", s[1], names))
            elif s[0] == "set_nullable" and not s[3]:
                if s[2] in rows.columns and not rows.where(F.col(s[2]).isNull()).isEmpty():
                    blocking.append(("nulls", *s[1:3]))
            elif s[0] == "create_index" and s[2]["unique"] and set(s[2]["columns"]) <= set(rows.columns):
                if not _repeated(rows, s[2]["columns"]).isEmpty():
                    blocking.append(("duplicates", s[1], s[2]["columns"]))
        return {"steps": steps, "destructive": destructive, "blocking": blocking, "base": C.digest(m["catalog"]), "version": m["version"]}

    def migrate(self, schema: str | dict, accept_data_loss: bool = False, plan: dict | None = None) -> dict:
        plan = plan or self.plan(schema)
        if plan["blocking"]:
            raise EngineError(CATALOG, "migration_blocked", str(plan["blocking"]))
        if plan["destructive"] and not accept_data_loss:
            raise EngineError(CATALOG, "data_loss", str(plan["destructive"]))
        before = self.store.manifest()
        if before["version"] != plan["version"] or C.digest(before["catalog"]) != plan["base"]:
            raise EngineError(CONFLICT, "catalog_changed", plan["base"])
        run = _Run(self, before, True)
        for step in plan["steps"]:
            run.change(step[0], *step[1:])
        return self.store.publish(before, run.changes.catalog, run.data, run.transitions) if plan["steps"] else before


def converted(value: Column, before: str, after: str) -> Column:
    """A strict conversion; null where a value has no exact counterpart."""
    if before == after:
        return value
    if after == T.TEXT:
        return value.cast("string")
    if before == T.TEXT and after == T.INT:
        return F.when(value.rlike(rf"\A(?:{C.WHOLE.pattern})\z"), value.try_cast("bigint"))
    if before == T.TEXT and after == T.FLOAT:
        number = value.try_cast("double")
        return F.when(value.rlike(rf"\A(?:{C.DECIMAL.pattern})\z") & (F.abs(number) < float("inf")), number)
    if before == T.TEXT and after == T.BOOL:
        return F.when(value == "true", F.lit(True)).when(value == "false", F.lit(False))
    if before == T.FLOAT and after == T.INT:
        fits = (value == F.floor(value).cast("double")) & (value >= -9223372036854775808.0) & (value < 9223372036854775808.0)
        return F.when(fits, value.cast("bigint"))
    if before == T.INT and after == T.FLOAT:
        number = value.cast("double")
        return F.when(number.cast("decimal(38,0)") == value.cast("decimal(38,0)"), number)
    return F.lit(None).cast(SPARK[after])


def _columns(t: dict) -> list:
    return [T.Column(c["name"], i, T.Type(c["type"], c["nullable"])) for i, c in enumerate(t["columns"])]


def _step(kind: str, s: dict) -> tuple[str, tuple]:
    """The catalog change that a statement asks for, and its arguments."""
    names = {
        "create_table": ("table",), "rename_table": ("table", "to"), "delete_table": ("table",), "create_column": ("table", "column"), "rename_column": ("table", "column", "to"),
        "change_column_default": ("table", "column", "default"), "delete_column": ("table", "column"), "create_index": ("table", "index"), "delete_index": ("table", "index"),
        "start_index_build": ("table", "index"), "start_column_replacement": ("table", "column", "type"), "start_constraint_validation": ("table", "column"),
    }
    step = {"start_index_build": "create_index", "start_column_replacement": "replace_type", "start_constraint_validation": "set_nullable"}.get(kind, kind)
    args = tuple(s.get(n) if n == "default" else s[n] for n in names[kind])
    return step, (*args, False) if step == "set_nullable" else args


def _repeated(df: DataFrame, names: list[str]) -> DataFrame:
    """Key values that stand more than once; a null anywhere makes a key unlike any other."""
    whole = df
    for n in names:
        whole = whole.where(F.col(f"`{n}`").isNotNull())
    return whole.groupBy(*(f"`{n}`" for n in names)).count().where("count > 1")


class _Run:
    """One program's state: the catalog and table versions as its statements leave them."""

    def __init__(self, db: Database, manifest: dict, allow_catalog: bool):
        self.db, self.spark, self.store, self.allow_catalog = db, db.spark, db.store, allow_catalog
        self.changes, self.data = C.Changes(manifest["catalog"]), dict(manifest["data"])
        self.published: dict[str, tuple[list, DataFrame]] = {}
        self.effects = False
        self.known = len(manifest.get("transitions", []))
        self.transitions: list[dict] = []

    def tables(self) -> Snapshot:
        return Snapshot(self.store, self.changes.catalog, self.data)

    def all(self, program: dict) -> dict:
        statements = program.get("statements") or []
        if not statements:
            raise EngineError(BIND, "empty_program")
        names = [s["name"] for s in statements if "name" in s]
        if len(set(names)) != len(names):
            raise EngineError(BIND, "duplicate_name")
        selected = program.get("result") or (names[0] if len(statements) == 1 and names else None)
        if selected is not None and selected not in names:
            raise EngineError(BIND, "unknown_result", selected)
        if selected is None and names:
            raise EngineError(BIND, "result_required")
        self._preflight(statements)
        affected, shapes = [], {}
        for s in statements:
            kind = s.get("kind")
            if kind == "query":
                shapes[s["name"]] = self._query(s)
                affected.append({"name": s["name"], "affected": 0, "control": False})
            elif kind in MUTATIONS:
                n = getattr(self, f"_{kind}")(s)
                shapes[s["name"]] = "many"
                affected.append({"name": s["name"], "affected": n, "control": False})
            elif kind in CATALOG_STATEMENTS:
                if not self.allow_catalog:
                    raise EngineError(CATALOG, "catalog_forbidden", kind)
                self._catalog(kind, s)
                affected.append({"name": s.get("name", kind), "affected": 0, "control": True})
            else:
                raise EngineError(BIND, "invalid_statement", str(kind))
        result = shaped(self.published[selected][1], shapes[selected]) if selected else None
        return {"result": result, "affected": affected}

    def _preflight(self, statements: list[dict]) -> None:
        """Binds every statement against the catalog that those before it leave, before any of them runs."""
        changes, columns = C.Changes(self.changes.catalog), {}
        for s in statements:
            tables = Snapshot(self.store, changes.catalog, {})
            kind = s.get("kind")
            if kind == "query":
                columns[s["name"]] = bind(s["relation"], tables, columns).root.output
            elif kind in MUTATIONS:
                t = C.table(changes.catalog, s["table"])
                self._bound_input(s, t, tables, columns)
                columns[s.get("name")] = _columns(t)
            elif kind not in CATALOG_STATEMENTS:
                raise EngineError(BIND, "invalid_statement", str(kind))
            elif not self.allow_catalog:
                raise EngineError(CATALOG, "catalog_forbidden", kind)
            else:
                step, args = _step(kind, s)
                getattr(changes, step)(*args)

    def _bound_input(self, s: dict, t: dict, tables: Snapshot, columns: dict[str, list]):
        """A mutation's input, bound and checked against the table and the kind of mutation."""
        relation = s["relation"]
        bound = bind(relation | {"root": relation["root"] | {"cardinality": "exactly_one"}}, tables, columns)
        known, given = {c["name"]: c for c in t["columns"]}, {c.name for c in bound.root.output}
        for c in bound.root.output:
            if c.name not in known:
                raise EngineError(BIND, "unknown_column", f"{s['table']}.{c.name}")
            if c.type.kind != known[c.name]["type"] or c.type.nullable and not known[c.name]["nullable"]:
                raise EngineError(BIND, "type_mismatch", f"{s['table']}.{c.name}")
        key = set(self._names(t, t["primary_key"]))
        if s["kind"] == "create":
            for c in t["columns"]:
                if c["name"] not in given and c["default"] is None and not c["nullable"]:
                    raise EngineError(BIND, "type_mismatch", f"{s['table']}.{c['name']} is required")
        elif s["kind"] == "update" and (not key <= given or key == given):
            raise EngineError(BIND, "update_shape", s["table"])
        elif s["kind"] == "delete" and given != key:
            raise EngineError(BIND, "delete_shape", s["table"])
        return bound

    def _publish(self, name: str, columns: list, df: DataFrame) -> None:
        self.published[name] = (columns, df)

    def _query(self, s: dict) -> str:
        engine = Engine(self.spark, self.tables())
        bound = bind(s["relation"], engine.tables, {n: c for n, (c, _) in self.published.items()})
        df = engine.lowered(bound, self.published)
        # Later statements may change the tables: the result is fixed now.
        self._publish(s["name"], bound.root.output, self._fixed(df, bound.root.ordered))
        return bound.cardinality

    def _fixed(self, df: DataFrame, ordered: bool) -> DataFrame:
        return df if ordered else cut(df, "statement")

    def _input(self, s: dict) -> tuple[dict, list, DataFrame]:
        """The target table, the input's columns and its rows, fixed once."""
        t = C.table(self.changes.catalog, s["table"])
        engine = Engine(self.spark, self.tables())
        bound = self._bound_input(s, t, engine.tables, {n: c for n, (c, _) in self.published.items()})
        return t, bound.root.output, cut(engine.lowered(bound, self.published), "input")

    def _names(self, t: dict, ids: list[int]) -> list[str]:
        by = {c["id"]: c["name"] for c in t["columns"]}
        return [by[i] for i in ids]

    def _create(self, s: dict) -> int:
        t, given, rows = self._input(s)
        have = {c.name for c in given}
        made = {}
        for c in t["columns"]:
            if c["name"] in have:
                made[c["name"]] = F.col(f"`{c['name']}`")
            elif c["default"] is not None:
                made[c["name"]] = self._default(c)
            else:
                made[c["name"]] = F.lit(None)
        new = rows.select(*(e.cast(SPARK[c["type"]]).alias(n) for (n, e), c in zip(made.items(), t["columns"])))
        new = cut(new, "created")  # generated defaults are drawn once
        old = self.tables().frame(s["table"])
        self._store(t, old.unionAll(new))
        self._check(t, touched=None, new=new)
        self._result(s, t, new)
        return new.count()

    def _default(self, c: dict) -> Column:
        if isinstance(c["default"], dict):
            return F.expr("uuid()") if c["default"]["generated"] == "uuid" else F.lit(int(time.time() * 1000))
        return F.lit(c["default"])

    def _targets(self, s: dict, t: dict, rows: DataFrame, key: list[str]) -> DataFrame:
        if not _repeated(rows, key).isEmpty():
            raise EngineError(EXECUTION, "mutation_target_ambiguous", s["table"])
        old = self.tables().frame(s["table"])
        if not rows.join(old.select(*key), key, "left_anti").isEmpty():
            raise EngineError(EXECUTION, "mutation_target_not_found", s["table"])
        return old

    def _update(self, s: dict) -> int:
        t, given, rows = self._input(s)
        key = self._names(t, t["primary_key"])
        touched = [c.name for c in given if c.name not in key]
        old = self._targets(s, t, rows, key)
        patch = rows.select(*(F.col(f"`{k}`") for k in key), F.struct(*(F.col(f"`{c}`") for c in touched)).alias("__patch"))
        joined = old.join(patch, key, "left")
        named = {c["name"]: F.col(f"`{c['name']}`") for c in t["columns"]}
        for c in touched:  # a null that was assigned counts: the patch's presence decides
            named[c] = F.when(F.col("__patch").isNotNull(), F.col(f"__patch.`{c}`")).otherwise(F.col(f"`{c}`"))
        self._store(t, joined.select(*(e.alias(n) for n, e in named.items())))
        current = self.tables().frame(s["table"])
        changed = current.join(rows.select(*key), key, "left_semi")
        self._check(t, touched=touched, new=changed)
        self._result(s, t, changed)
        return rows.count()

    def _delete(self, s: dict) -> int:
        t, given, rows = self._input(s)
        key = self._names(t, t["primary_key"])
        old = self._targets(s, t, rows, key)
        gone = cut(old.join(rows, key, "left_semi"), "deleted")
        self._store(t, old.join(rows, key, "left_anti").select(*(c["name"] for c in t["columns"])))
        for other in self.changes.catalog["tables"]:
            for f in other["foreign_keys"]:
                if f["table"] == t["id"]:
                    self._references(other, f, only=gone.select(*key))
        self._result(s, t, gone)
        return gone.count()

    def _store(self, t: dict, df: DataFrame) -> None:
        self.data[str(t["id"])] = self.store.write(df, t)
        self.effects = True

    def _result(self, s: dict, t: dict, df: DataFrame) -> None:
        self._publish(s["name"], _columns(t), cut(df, "result"))

    # -- constraints -------------------------------------------------------------------------------

    def _check(self, t: dict, touched: list[str] | None, new: DataFrame) -> None:
        """Keys, uniqueness and references of the table as it now is; ``touched`` None: all columns."""
        current = self.tables().frame(t["name"])
        reach = lambda names: touched is None or set(names) & set(touched)
        keys = [("primary key", self._names(t, t["primary_key"]))] + [(i["name"], self._names(t, i["columns"])) for i in t["indexes"] if i["unique"]]
        for label, names in keys:
            if reach(names) and not _repeated(current.join(new.select(*names).distinct(), names, "left_semi"), names).isEmpty():
                raise _violation(f"{t['name']}: {label}")
        for f in t["foreign_keys"]:
            if reach(self._names(t, f["columns"])):
                self._references(t, f)

    def _references(self, t: dict, f: dict, only: DataFrame | None = None) -> None:
        parent = next(p for p in self.changes.catalog["tables"] if p["id"] == f["table"])
        names, key = self._names(t, f["columns"]), self._names(parent, parent["primary_key"])
        rows = self.tables().frame(t["name"])
        for n in names:
            rows = rows.where(F.col(f"`{n}`").isNotNull())
        used = rows.select(*(F.col(f"`{n}`").alias(k) for n, k in zip(names, key))).distinct()
        lost = used.join(only, key, "left_semi") if only is not None else used.join(self.tables().frame(parent["name"]).select(*key), key, "left_anti")
        if not lost.isEmpty():
            raise _violation(f"{t['name']}: {f['name']}")

    # -- catalog -----------------------------------------------------------------------------------

    def _catalog(self, kind: str, s: dict) -> None:
        step, args = _step(kind, s)
        self.change(step, *args)
        if kind.startswith("start_"):
            of = s["index"]["columns"] if kind == "start_index_build" else [s["column"]]
            self.transitions.append({"id": self.known + len(self.transitions) + 1, "kind": kind.removeprefix("start_"), "table": s["table"], "columns": of, "state": "completed"})

    def change(self, step: str, *args: Any) -> None:
        """One catalog change, with the data that it has to look at or rewrite."""
        before = self.tables()
        if step == "replace_type":
            name, of, kind = args
            t = C.table(self.changes.catalog, name)
            old, rows = C.column(t, of)["type"], before.frame(name)
            value = converted(F.col(f"`{of}`"), old, kind)
            if not rows.where(F.col(f"`{of}`").isNotNull() & value.isNull()).isEmpty():
                raise EngineError(CATALOG, "conversion_failed", f"{name}.{of} to {kind}")
            self.changes.replace_type(name, of, kind)
            t = C.table(self.changes.catalog, name)
            self._store(t, rows.withColumn(of, value))
            now = self.tables().frame(name)
            for i in t["indexes"]:
                names = self._names(t, i["columns"])
                if i["unique"] and of in names and not _repeated(now, names).isEmpty():
                    raise _violation(f"{name}: {i['name']}")
            for f in t["foreign_keys"]:
                if of in self._names(t, f["columns"]):
                    parent = next(p for p in self.changes.catalog["tables"] if p["id"] == f["table"])
                    if [c["type"] for k in parent["primary_key"] for c in parent["columns"] if c["id"] == k] != [C.column(t, c)["type"] for c in self._names(t, f["columns"])]:
                        raise EngineError(CATALOG, "foreign_key_shape", f"{name} to {parent['name']}")
                    self._references(t, f)
        elif step == "set_nullable":
            name, of, nullable = args
            if not nullable and not before.frame(name).where(F.col(f"`{of}`").isNull()).isEmpty():
                raise EngineError(CATALOG, "null_values", f"{name}.{of}")
            self.changes.set_nullable(name, of, nullable)
        elif step == "create_foreign_key":
            made = self.changes.create_foreign_key(*args)
            self._references(C.table(self.changes.catalog, args[0]), made)
        elif step == "create_index":
            self.changes.create_index(*args)
            if args[1].get("unique") and not _repeated(before.frame(args[0]), args[1]["columns"]).isEmpty():
                raise _violation(f"{args[0]}: {args[1]['columns']}")
        else:
            t = C.table(self.changes.catalog, args[0]) if step == "delete_table" else None
            getattr(self.changes, step)(*args)
            if t is not None:
                self.data.pop(str(t["id"]), None)
        self.effects = True
