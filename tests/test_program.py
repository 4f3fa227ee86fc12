"""Programs, constraints and migrations over the versioned store."""

import pytest

from lattica.errors import EngineError
from lattica.plans import build as b
from lattica.program import Database
from lattica.sources import catalog as C

SCHEMA = {
    "tables": {
        "users": {"columns": {"id": {"type": "text", "pk": True}, "name": "text", "email": {"type": "text?", "unique": True}, "age": "int64?"}},
        "posts": {"columns": {"id": {"type": "text", "pk": True, "default": {"generated": "uuid"}}, "user_id": {"type": "text?", "ref": "users.id"}, "title": "text", "score": {"type": "int64", "default": 2}}},
    }
}
USERS = [("u1", "Ann", "a@x"), ("u2", "Ben", None), ("u3", "Cid", None)]


@pytest.fixture
def db(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    db.migrate(SCHEMA)
    db.execute({"statements": [create("users", b.rows("r", {"id": "text", "name": "text", "email": "text?"}, USERS), "made")]})
    return db


def create(table, relation, name="s"):
    return mutate("create", table, relation, name)


def mutate(kind, table, relation, name="s"):
    return {"kind": kind, "name": name, "table": table, "relation": b.query(relation, "many")}


def users(db):
    return db.query(b.query(b.project(b.order(b.scan("users", "u"), "@u.id"), id="@u.id", name="@u.name", email="@u.email", age="@u.age")))


def reason(db, *statements, **more):
    before = db.store.version()
    with pytest.raises(EngineError) as error:
        db.execute({"statements": list(statements), "result": statements[-1].get("name")}, **more)
    assert db.store.version() == before  # nothing of a failed program stays
    return error.value.reason


def test_create_update_delete(db):
    out = db.execute({"statements": [
        create("posts", b.rows("r", {"id": "text", "user_id": "text?", "title": "text"}, [("p1", "u1", "t"), ("p2", None, "t2")]), "made"),
        mutate("update", "users", b.project(b.where(b.scan("users", "u"), b.eq("@u.id", "u1")), id="@u.id", email=b.null("text"), age=b.lit(7)), "changed"),
        {"kind": "query", "name": "seen", "relation": b.query(b.project(b.order(b.join(b.ref("made", "m"), b.ref("changed", "c"), b.eq("@m.user_id", "@c.id")), "@m.id"), post="@m.id", score="@m.score", age="@c.age"))},
    ], "result": "seen"})
    assert out["result"] == [{"post": "p1", "score": 2, "age": 7}]
    assert [a["affected"] for a in out["affected"]] == [2, 1, 0]
    assert users(db)[0] == {"id": "u1", "name": "Ann", "email": None, "age": 7}
    assert reason(db, mutate("delete", "users", b.project(b.where(b.scan("users", "u"), b.eq("@u.id", "u1")), id="@u.id"))) == "constraint_violation"
    gone = db.execute({"statements": [mutate("delete", "users", b.project(b.where(b.scan("users", "u"), b.eq("@u.id", "u2")), id="@u.id"))]})
    assert gone["result"][0]["name"] == "Ben" and [u["id"] for u in users(db)] == ["u1", "u3"]


def test_update_reads_the_state_before_it(db):
    db.execute({"statements": [mutate("update", "users", b.project(b.scan("users", "u"), id="@u.id", age=b.lit(1)))]})
    total = b.scalar(b.aggregate(b.scan("users", "w"), scope="a", n=("sum", "@w.age")))
    db.execute({"statements": [mutate("update", "users", b.project(b.scan("users", "u"), id="@u.id", age=total))]})
    assert [u["age"] for u in users(db)] == [3, 3, 3]


def test_constraints(db):
    rows = lambda *data: b.rows("r", {"id": "text", "name": "text", "email": "text?"}, list(data))
    assert reason(db, create("users", rows(("u1", "again", None)))) == "constraint_violation"
    assert reason(db, create("users", rows(("u9", "x", None), ("u9", "y", None)))) == "constraint_violation"
    assert reason(db, create("users", rows(("u9", "x", "a@x")))) == "constraint_violation"
    assert reason(db, create("posts", b.rows("r", {"user_id": "text?", "title": "text"}, [("nobody", "t")]))) == "constraint_violation"
    assert reason(db, create("users", b.rows("r", {"id": "text"}, [("u9",)]))) == "type_mismatch"
    assert reason(db, create("users", b.rows("r", {"id": "text", "nope": "text"}, [("u9", "x")]))) == "unknown_column"
    assert reason(db, create("users", b.rows("r", {"id": "text", "name": "text?"}, [("u9", None)]))) == "type_mismatch"
    pair = b.rows("r", {"id": "text", "age": "int64?"}, [("u1", 1), ("u1", 2)])
    assert reason(db, mutate("update", "users", pair)) == "mutation_target_ambiguous"
    assert reason(db, mutate("update", "users", b.rows("r", {"id": "text", "age": "int64?"}, [("u8", 1)]))) == "mutation_target_not_found"
    assert reason(db, create("users", rows(("u9", "x", None)), "a"), create("users", rows(("u9", "x", None)), "z")) == "constraint_violation"
    assert len(users(db)) == 3
    db.execute({"statements": [create("users", rows(("u9", "x", None)))]}, dry_run=True)
    assert len(users(db)) == 3


def test_two_writers_conflict(db, spark):
    before = db.store.manifest()
    db.store.publish(before, before["catalog"], before["data"])
    with pytest.raises(EngineError, match="serializable_conflict"):
        db.store.publish(before, before["catalog"], before["data"])


def test_catalog_statements(db):
    db.execute({"statements": [
        {"kind": "create_column", "table": "users", "column": {"name": "tier", "type": "text", "default": "free"}},
        {"kind": "rename_column", "table": "users", "column": "name", "to": "full_name"},
        {"kind": "create_index", "table": "users", "index": {"columns": ["full_name"], "unique": True}},
        {"kind": "change_column_default", "table": "users", "column": "tier", "default": "paid"},
    ]})
    db.execute({"statements": [create("users", b.rows("r", {"id": "text", "full_name": "text"}, [("u4", "Dan")]))]})
    got = db.query(b.query(b.project(b.order(b.scan("users", "u"), "@u.id"), n="@u.full_name", t="@u.tier")))
    assert got == [{"n": "Ann", "t": "free"}, {"n": "Ben", "t": "free"}, {"n": "Cid", "t": "free"}, {"n": "Dan", "t": "paid"}]
    assert reason(db, {"kind": "delete_table", "table": "users"}) == "table_referenced"
    assert reason(db, {"kind": "delete_column", "table": "users", "column": "id"}) == "column_in_use"
    assert reason(db, {"kind": "create_column", "table": "users", "column": {"name": "x", "type": "text", "nullable": False}}) == "column_needs_default"
    assert reason(db, {"kind": "create_column", "table": "users", "column": {"name": "y", "type": "text", "nullable": True}}, allow_catalog=False) == "catalog_forbidden"
    assert reason(db, {"kind": "start_constraint_validation", "table": "users", "column": "email"}) == "null_values"
    assert reason(db, {"kind": "start_column_replacement", "table": "users", "column": "full_name", "type": "int64"}) == "conversion_failed"


def test_migration(db):
    import copy

    wanted = copy.deepcopy(SCHEMA)
    wanted["tables"]["users"]["columns"]["age"] = "text?"
    wanted["tables"]["posts"]["columns"].pop("score")
    wanted["tables"]["tags"] = {"columns": {"id": {"type": "text", "pk": True}, "post": {"type": "text?", "ref": "posts.id"}}}
    plan = db.plan(wanted)
    assert [s[0] for s in plan["steps"]] == ["create_table", "replace_type", "delete_column"] and len(plan["destructive"]) == 1
    with pytest.raises(EngineError, match="data_loss"):
        db.migrate(wanted)
    db.execute({"statements": [mutate("update", "users", b.rows("r", {"id": "text", "age": "int64?"}, [("u1", 41)]))]})
    with pytest.raises(EngineError, match="catalog_changed"):
        db.migrate(wanted, accept_data_loss=True, plan=plan)
    made = db.migrate(wanted, accept_data_loss=True)
    assert users(db)[0]["age"] == "41" and not db.plan(wanted)["steps"]
    assert [h["hash"] for h in made["history"]][-1] == C.digest(made["catalog"])
    blocked = copy.deepcopy(wanted)
    blocked["tables"]["users"]["columns"]["name"] = "int64"
    blocked["tables"]["users"]["columns"]["email"] = {"type": "text", "unique": True}
    assert {x[0] for x in db.plan(blocked)["blocking"]} == {"conversion", "nulls"}
    with pytest.raises(EngineError, match="migration_blocked"):
        db.migrate(blocked)
    swapped = copy.deepcopy(wanted)
    swapped["tables"]["users"]["columns"] = dict(reversed(wanted["tables"]["users"]["columns"].items()))
    with pytest.raises(EngineError, match="unsupported_difference"):
        db.plan(swapped)


def test_columns_with_an_id_are_renamed_and_foreign_keys_follow_the_schema(db):
    import copy

    wanted = copy.deepcopy(SCHEMA)
    wanted["tables"]["users"]["columns"]["name"] = {"type": "text", "id": "n1"}
    assert not db.plan(wanted)["destructive"]
    named = {"tables": {"a": {"columns": {"id": {"type": "int64", "pk": True}, "x": {"type": "text?", "id": "c1"}, "y": {"type": "text?", "id": "c2"}}}} | SCHEMA["tables"]}
    db.migrate(named)
    db.execute({"statements": [create("a", b.rows("r", {"id": "int64", "x": "text?", "y": "text?"}, [(1, "one", "u1")]))]})
    moved = copy.deepcopy(named)
    moved["tables"]["a"]["columns"] = {"id": {"type": "int64", "pk": True}, "z": {"type": "text?", "id": "c1"}, "x": {"type": "text?", "id": "c2", "ref": "users.id"}}
    assert [s[0] for s in db.plan(moved)["steps"]] == ["rename_column", "rename_column", "create_foreign_key"]
    db.migrate(moved)
    assert db.snapshot().frame("a").collect() == [(1, "one", "u1")] and db.snapshot().frame("a").columns == ["id", "z", "x"]
    assert not db.plan(moved)["steps"]
    assert reason(db, mutate("delete", "users", b.project(b.where(b.scan("users", "u"), b.eq("@u.id", "u1")), id="@u.id"))) == "constraint_violation"
    moved["tables"]["a"]["columns"]["x"] = {"type": "text?", "id": "c2"}
    assert [s[0] for s in db.plan(moved)["steps"]] == ["delete_foreign_key"]


def test_new_foreign_keys_check_the_rows_that_are_there(db):
    named = {"tables": {"a": {"columns": {"id": {"type": "int64", "pk": True}, "y": "text?"}}} | SCHEMA["tables"]}
    db.migrate(named)
    db.execute({"statements": [create("a", b.rows("r", {"id": "int64", "y": "text?"}, [(1, "nobody")]))]})
    named["tables"]["a"]["columns"]["y"] = {"type": "text?", "ref": "users.id"}
    with pytest.raises(EngineError, match="constraint_violation"):
        db.migrate(named)


def test_replaced_types_keep_constraints_and_defaults(db):
    db.migrate({"tables": {"a": {"columns": {"id": {"type": "int64", "pk": True}, "y": {"type": "text?", "unique": True, "default": "7"}}}} | SCHEMA["tables"]})
    db.execute({"statements": [create("a", b.rows("r", {"id": "int64", "y": "text?"}, [(1, "1"), (2, "01")]))]})
    change = {"kind": "start_column_replacement", "table": "a", "column": "y", "type": "int64"}
    assert reason(db, change) == "constraint_violation"
    wanted = {"tables": {"a": {"columns": {"id": {"type": "int64", "pk": True}, "y": {"type": "int64?", "unique": True}}}} | SCHEMA["tables"]}
    assert [x[0] for x in db.plan(wanted)["blocking"]] == ["duplicates"]
    db.execute({"statements": [mutate("update", "a", b.rows("r", {"id": "int64", "y": "text?"}, [(2, "2")]))]})
    db.execute({"statements": [change, create("a", b.rows("r", {"id": "int64"}, [(3,)]))], "result": "s"})
    assert sorted(r["y"] for r in db.snapshot().frame("a").collect()) == [1, 2, 7]
    assert [(t["kind"], t["state"]) for t in db.transitions()] == [("column_replacement", "completed")] and db.transition(1)["table"] == "a"
    with pytest.raises(EngineError, match="transition_not_active"):
        db.cancel_transition(1)
    with pytest.raises(EngineError, match="transition_not_found"):
        db.transition(9)


@pytest.mark.parametrize("text, kind, want", [("12\n", "int64", None), ("+12", "int64", 12), ("1.5d", "float64", None), (" 1.5", "float64", None), ("1e2", "float64", 100.0), ("NaN", "float64", None), ("true", "bool", True)])
def test_conversions_are_strict(spark, text, kind, want):
    from lattica.program import converted

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(converted(df["t"], "text", kind)).first()[0] == want
