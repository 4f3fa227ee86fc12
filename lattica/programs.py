"""Registered queries that run programs and migrations in the shared folder, each with SQL for what is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.errors import EngineError
from lattica.plans import build as b
from lattica.program import Database
from lattica.sources.shared import new_path

NATIONS = {"columns": {"id": {"type": "int64", "pk": True}, "name": {"type": "text", "id": "nation-name"}, "region": {"type": "int64?"}, "note": {"type": "text?", "default": "new"}}}
PORTS = {"columns": {"id": {"type": "int64", "pk": True}, "nation": {"type": "int64", "ref": "nations.id"}}}


def _statement(kind: str, table: str, relation: b.Rel, name: str = "s") -> dict:
    return {"kind": kind, "name": name, "table": table, "relation": b.query(relation, "many")}


def _database(spark: SparkSession, sf_dir: str) -> Database:
    """All of ``nation`` (25 rows at any scale) as a table of a new store, and an empty table that refers to it."""
    db = Database(spark, new_path(spark, "database"))
    db.migrate({"tables": {"nations": NATIONS, "ports": PORTS}})
    found = [(int(r["n_nationkey"]), r["n_name"], int(r["n_regionkey"])) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()]
    db.execute({"statements": [_statement("create", "nations", b.rows("r", {"id": "int64", "name": "text", "region": "int64?"}, found))]})
    return db


def _where(condition) -> b.Rel:
    return b.where(b.scan("nations", "n"), condition)


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, update and delete in programs whose statements see each other's effects."""
    db = _database(spark, sf_dir)
    db.execute({"statements": [
        _statement("update", "nations", b.project(_where(b.eq("@n.region", 2)), id="@n.id", note=b.null("text")), "changed"),
        _statement("create", "ports", b.project(b.ref("changed", "c"), id=b.add("@c.id", 100), nation="@c.id"), "made"),
        _statement("delete", "ports", b.project(b.scan("ports", "p"), id="@p.id"), "closed"),
        _statement("delete", "nations", b.project(_where(b.gte("@n.id", 20)), id="@n.id"), "gone"),
    ], "result": "gone"})
    return db.snapshot().frame("nations")


def migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that keeps its id is renamed, one changes its type, one goes and one comes."""
    db = _database(spark, sf_dir)
    columns = {"id": NATIONS["columns"]["id"], "label": NATIONS["columns"]["name"], "region": "text?", "extra": {"type": "int64", "default": 5}}
    db.migrate({"tables": {"nations": {"columns": columns}, "ports": PORTS}}, accept_data_loss=True)
    return db.snapshot().frame("nations")


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each forbidden program is refused for; none leaves a trace."""
    db = _database(spark, sf_dir)
    new = lambda *data: b.rows("r", {"id": "int64", "name": "text"}, list(data))
    cases = {
        "repeated key": [_statement("create", "nations", new((3, "x")))],
        "no parent": [_statement("create", "ports", b.rows("r", {"id": "int64", "nation": "int64"}, [(1, 99)]))],
        "no target": [_statement("update", "nations", new((99, "x")))],
        "one target twice": [_statement("update", "nations", new((1, "x"), (1, "y")))],
        "still referred to": [_statement("create", "ports", b.rows("r", {"id": "int64", "nation": "int64"}, [(1, 7)]), "a"), _statement("delete", "nations", b.project(_where(b.eq("@n.id", 7)), id="@n.id"), "z")],
        "required column": [_statement("create", "nations", b.rows("r", {"id": "int64"}, [(77,)]))],
        "last statement has a wrong type": [_statement("create", "nations", new((88, "x")), "a"), _statement("create", "nations", b.rows("r", {"id": "text", "name": "text"}, [("k", "x")]), "z")],
    }
    found, version = [], db.store.version()
    for name, statements in cases.items():
        try:
            db.execute({"statements": statements, "result": statements[-1]["name"]})
        except EngineError as error:
            found.append((name, error.reason, db.store.version() == version))
    return spark.createDataFrame(found, "refused string, reason string, unchanged boolean")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of online changes."""
    db = _database(spark, sf_dir)
    db.execute({"statements": [
        {"kind": "start_index_build", "table": "nations", "index": {"columns": ["name"], "unique": True}},
        {"kind": "start_column_replacement", "table": "nations", "column": "region", "type": "float64"},
        {"kind": "start_constraint_validation", "table": "nations", "column": "region"},
    ]})
    return spark.createDataFrame([(t["id"], t["kind"], t["table"], ",".join(t["columns"]), t["state"]) for t in db.transitions()], "id long, kind string, on_table string, on_columns string, state string")


PROGRAMS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "program_mutations": (mutations, "SELECT n_nationkey::BIGINT id, n_name AS name, n_regionkey::BIGINT region, CASE WHEN n_regionkey = 2 THEN NULL ELSE 'new' END note FROM nation WHERE n_nationkey < 20"),
    "program_migration": (migration, "SELECT n_nationkey::BIGINT id, n_name AS label, n_regionkey::VARCHAR region, 5::BIGINT extra FROM nation"),
    "program_constraints": (constraints, "SELECT * FROM (VALUES ('repeated key', 'constraint_violation', true), ('no parent', 'constraint_violation', true), ('no target', 'mutation_target_not_found', true), ('one target twice', 'mutation_target_ambiguous', true), ('still referred to', 'constraint_violation', true), ('required column', 'type_mismatch', true), ('last statement has a wrong type', 'type_mismatch', true)) t(refused, reason, unchanged)"),
    "program_transitions": (transitions, "SELECT * FROM (VALUES (1::BIGINT, 'index_build', 'nations', 'name', 'completed'), (2, 'column_replacement', 'nations', 'region', 'completed'), (3, 'constraint_validation', 'nations', 'region', 'completed')) t(id, kind, on_table, on_columns, state)"),
}
