"""Registered queries of the relational engine, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.engine import Engine

from lattica.plans.build import Rel
from lattica.programs import PROGRAMS
from lattica.sources.parquet import ParquetTables

#: Logical primary keys of the tables; lineitem has none.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "pages": ("page_id",), "benchmark": ("item_id",), "embeddings": ("vec_id",), "conversations": ("conv_id", "turn"),
}


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    return Engine(spark, ParquetTables(spark, sf_dir, KEYS), **options)


def _queries() -> dict[str, tuple[dict, str]]:
    from lattica.plans import build as b

    c = lambda name: b.expr("@" + name)
    q: dict[str, tuple[dict, str]] = {}

    def add(name: str, root: Rel, sql: str, *by: str, cardinality: str = "many", **bindings) -> None:
        if by and root["kind"] == "project" and "scope" not in root:  # a projection closes the scopes that the order names
            root = Rel(root | {"input": b.order(root["input"], *map(c, by))})
        elif by:
            root = b.order(root, *map(c, by))
        q[name] = (b.query(root, cardinality, **bindings), sql)

    # Scans, rows, projection -----------------------------------------------------------------------
    nation, region, customer, orders, lineitem = (lambda s, t=t: b.scan(t, s) for t in ("nation", "region", "customer", "orders", "lineitem"))
    add("scan_project", b.project(nation("n"), ["n"], double_key=b.mul("@n.n_nationkey", 2)),
        "SELECT n_nationkey::BIGINT n_nationkey, n_name, n_regionkey::BIGINT n_regionkey, (n_nationkey * 2)::BIGINT double_key FROM nation", "n.n_nationkey")
    values = [("a", 1, 1.5, True), ("b", None, -0.0, False), ("c", -9223372036854775808, 2.25, None), ("a", 7, None, True)]
    add("rows_literal", b.project(b.rows("r", {"k": "text", "i": "int64?", "f": "float64?", "t": "bool?"}, values), ["r"]),
        "SELECT * FROM (VALUES ('a', 1::BIGINT, 1.5::DOUBLE, true), ('b', NULL, 0.0, false), ('c', -9223372036854775808, 2.25, NULL), ('a', 7, NULL, true)) r(k, i, f, t)", "r.k", "r.i")
    add("rows_empty", b.aggregate(b.rows("r", {"k": "text"}, []), scope="a", n="count"), "SELECT 0::BIGINT n", cardinality="exactly_one")
    add("key_lookup", b.where(customer("c"), b.eq("@c.c_custkey", 42)),
        "SELECT c_custkey, c_name, c_nationkey::BIGINT c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 42", cardinality="exactly_one")
    add("key_range", b.project(b.where(orders("o"), b.and_(b.gte("@o.o_orderkey", 100), b.lt("@o.o_orderkey", 300))), o_orderkey="@o.o_orderkey", o_custkey="@o.o_custkey"),
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300", "o.o_orderkey")
    add("timestamps_as_millis", b.aggregate(b.scan("events", "e"), {"event_type": "@e.event_type"}, scope="a", first_ts=("min", "@e.ts"), last_ts=("max", "@e.ts"), n="count"),
        "SELECT event_type, epoch_us(min(ts)) // 1000 first_ts, epoch_us(max(ts)) // 1000 last_ts, count(*) n FROM events GROUP BY ALL", "a.event_type")

    # Predicates ------------------------------------------------------------------------------------
    padded = lambda: b.project(b.join(orders("o"), b.where(b.scan("customer", "c"), b.gt("@c.c_acctbal", 0.0)), b.eq("@o.o_custkey", "@c.c_custkey"), "left"), scope="p", k="@o.o_orderkey", bal="@c.c_acctbal", seg="@c.c_mktsegment")
    padded_sql = "(SELECT o_orderkey k, c_acctbal bal, c_mktsegment seg FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey) p"
    add("filter_k3_not", b.project(b.where(padded(), b.not_(b.gt("@p.bal", 5000.0))), ["p"]), f"SELECT k, bal, seg FROM {padded_sql} WHERE NOT bal > 5000", "p.k")
    add("filter_is_null", b.project(b.where(padded(), b.is_null("@p.bal")), k="@p.k"), f"SELECT k FROM {padded_sql} WHERE bal IS NULL", "p.k")
    add("filter_is_not_null", b.project(b.where(padded(), b.is_not_null("@p.seg")), k="@p.k", seg="@p.seg"), f"SELECT k, seg FROM {padded_sql} WHERE seg IS NOT NULL", "p.k")
    add("filter_and_or", b.aggregate(b.where(lineitem("l"), b.or_(b.and_(b.eq("@l.l_returnflag", "R"), b.gt("@l.l_quantity", 30.0)), b.and_(b.lt("@l.l_discount", 0.02), b.ne("@l.l_linestatus", "O")))), {"l_returnflag": "@l.l_returnflag"}, scope="a", n="count", q=("max", "@l.l_quantity")),
        "SELECT l_returnflag, count(*) n, max(l_quantity) q FROM lineitem WHERE (l_returnflag = 'R' AND l_quantity > 30) OR (l_discount < 0.02 AND l_linestatus <> 'O') GROUP BY ALL", "a.l_returnflag")
    add("kleene_tables", b.project(padded(), k="@p.k", a=b.and_(b.gt("@p.bal", 100.0), b.lt("@p.k", 1000)), o=b.or_(b.gt("@p.bal", 100.0), b.lt("@p.k", 1000)), n=b.not_(b.gt("@p.bal", 100.0))),
        f"SELECT k, bal > 100 AND k < 1000 a, bal > 100 OR k < 1000 o, NOT bal > 100 n FROM {padded_sql}", "p.k")

    # Expressions -----------------------------------------------------------------------------------
    o = lambda: orders("o")
    add("expr_int_arith", b.project(o(), k="@o.o_orderkey", a=b.add("@o.o_orderkey", "@o.o_custkey"), s=b.sub("@o.o_custkey", "@o.o_orderkey"), m=b.mul("@o.o_orderkey", "@o.o_custkey"), g=b.negate("@o.o_custkey")),
        "SELECT o_orderkey k, o_orderkey + o_custkey a, o_custkey - o_orderkey s, o_orderkey * o_custkey m, -o_custkey g FROM orders", "o.o_orderkey")
    add("expr_int_div_trunc", b.project(o(), k="@o.o_orderkey", d=b.div(b.sub(100, "@o.o_orderkey"), 7)), "SELECT o_orderkey k, (100 - o_orderkey) // 7 d FROM orders", "o.o_orderkey")
    add("expr_float_arith", b.project(o(), k="@o.o_orderkey", half=b.mul("@o.o_totalprice", 0.5), more=b.add("@o.o_totalprice", 1.25), ratio=b.div("@o.o_totalprice", 4.0), neg=b.negate("@o.o_totalprice"), mixed=b.sub("@o.o_totalprice", "@o.o_custkey")),
        "SELECT o_orderkey k, o_totalprice * 0.5::DOUBLE half, o_totalprice + 1.25::DOUBLE more, o_totalprice / 4.0::DOUBLE ratio, -o_totalprice neg, o_totalprice - o_custkey::DOUBLE mixed FROM orders", "o.o_orderkey")
    add("cast_float_to_int", b.project(o(), k="@o.o_orderkey", t=b.cast(b.negate("@o.o_totalprice"), "int64")), "SELECT o_orderkey k, trunc(-o_totalprice)::BIGINT t FROM orders", "o.o_orderkey")
    add("cast_int_to_float", b.project(o(), k="@o.o_orderkey", f=b.cast("@o.o_custkey", "float64")), "SELECT o_orderkey k, o_custkey::DOUBLE f FROM orders", "o.o_orderkey")
    add("branch_classify", b.aggregate(b.project(orders("o"), scope="p", band=b.branch((b.lt("@o.o_totalprice", 1000.0), "low"), (b.lt("@o.o_totalprice", 100000.0), "mid"), otherwise="high")), {"band": "@p.band"}, scope="a", n="count"),
        "SELECT CASE WHEN o_totalprice < 1000 THEN 'low' WHEN o_totalprice < 100000 THEN 'mid' ELSE 'high' END band, count(*) n FROM orders GROUP BY 1", "a.band")
    part = lambda: b.scan("part", "p")
    for name, pattern, like in (("prefix", "a*", "a%"), ("suffix", "*e", "%e"), ("contains", "*an*", "%an%"), ("multi", "*a*e*", "%a%e%")):
        add(f"textmatch_{name}", b.project(b.where(part(), b.match("@p.p_name", pattern)), k="@p.p_partkey", n="@p.p_name"), f"SELECT p_partkey k, p_name n FROM part WHERE p_name LIKE '{like}'", "p.p_partkey")
    add("textmatch_exact", b.aggregate(b.where(customer("c"), b.match("@c.c_mktsegment", "BUILDING")), scope="a", n="count"), "SELECT count(*) n FROM customer WHERE c_mktsegment = 'BUILDING'", cardinality="exactly_one")
    add("textmatch_escapes", b.aggregate(b.where(b.scan("documents", "d"), b.match("@d.text", "*%*_*")), scope="a", n="count"), "SELECT count(*) n FROM documents WHERE text LIKE '%!%%!_%' ESCAPE '!'", cardinality="exactly_one")
    add("textmatch_fold", b.aggregate(b.where(customer("c"), b.match("@c.c_mktsegment", "bUiLd*", fold=True)), scope="a", n="count"), "SELECT count(*) n FROM customer WHERE lower(c_mktsegment) LIKE 'build%'", cardinality="exactly_one")

    folded = [("ÄPFEL",), ("äpfel",), ("Äpfel",), ("apfel",), ("ΣΊΓΜΑ",), ("σίγμα",), ("ẞ",), ("ß",), ("ss",)]
    for name, pattern, found in (("latin", "äPf*", "('ÄPFEL'), ('äpfel'), ('Äpfel')"), ("greek", "σΊγ*Α", "('ΣΊΓΜΑ'), ('σίγμα')"), ("sharp", "ß", "('ẞ'), ('ß')")):
        add(f"textmatch_fold_{name}", b.project(b.where(b.rows("r", {"k": "text"}, folded), b.match("@r.k", pattern, fold=True)), ["r"]), f"SELECT * FROM (VALUES {found}) t(k)", "r.k")

    # Joins -----------------------------------------------------------------------------------------
    add("join_inner", b.project(b.join(nation("n"), region("r"), b.eq("@n.n_regionkey", "@r.r_regionkey")), n_name="@n.n_name", r_name="@r.r_name"),
        "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "n.n_name")
    add("join_left", b.project(b.join(customer("c"), b.where(orders("o"), b.gt("@o.o_totalprice", 400000.0)), b.eq("@c.c_custkey", "@o.o_custkey"), "left"), c_custkey="@c.c_custkey", o_orderkey="@o.o_orderkey"),
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey", "c.c_custkey", "o.o_orderkey")
    add("join_theta", b.project(b.join(nation("n"), region("r"), b.gt("@n.n_nationkey", b.mul("@r.r_regionkey", 6))), n="@n.n_nationkey", r="@r.r_regionkey"),
        "SELECT n_nationkey::BIGINT n, r_regionkey::BIGINT r FROM nation JOIN region ON n_nationkey > r_regionkey * 6", "n.n_nationkey", "r.r_regionkey")
    add("join_cross", b.project(b.join(nation("n"), region("r"), True), n="@n.n_nationkey", r="@r.r_regionkey"), "SELECT n_nationkey::BIGINT n, r_regionkey::BIGINT r FROM nation CROSS JOIN region", "n.n_nationkey", "r.r_regionkey")
    add("join_self", b.project(b.join(nation("a"), nation("z"), b.and_(b.eq("@a.n_regionkey", "@z.n_regionkey"), b.lt("@a.n_nationkey", "@z.n_nationkey"))), a="@a.n_nationkey", z="@z.n_nationkey"),
        "SELECT a.n_nationkey::BIGINT a, z.n_nationkey::BIGINT z FROM nation a JOIN nation z ON a.n_regionkey = z.n_regionkey AND a.n_nationkey < z.n_nationkey", "a.n_nationkey", "z.n_nationkey")
    add("antijoin_left_null", b.project(b.where(b.join(orders("o"), lineitem("l"), b.eq("@o.o_orderkey", "@l.l_orderkey"), "left"), b.is_null("@l.l_orderkey")), o_orderkey="@o.o_orderkey"),
        "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL", "o.o_orderkey")
    items = lambda s="l": b.where(b.scan("lineitem", s), b.eq(f"@{s}.l_orderkey", "@o.o_orderkey"))
    add("antijoin_not_exists", b.project(b.where(orders("o"), b.not_(b.exists(items()))), o_orderkey="@o.o_orderkey"), "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", "o.o_orderkey")
    add("semi_exists", b.project(b.where(orders("o"), b.exists(b.where(items(), b.gt("@l.l_quantity", 49.0)))), o_orderkey="@o.o_orderkey"),
        "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)", "o.o_orderkey")

    # Aggregation, distinct -------------------------------------------------------------------------
    add("agg_global", b.aggregate(orders("o"), scope="a", n="count", s=("sum", "@o.o_custkey"), lo=("min", "@o.o_totalprice"), hi=("max", "@o.o_totalprice"), mean=("avg", "@o.o_custkey")),
        "SELECT count(*) n, sum(o_custkey)::BIGINT s, min(o_totalprice) lo, max(o_totalprice) hi, avg(o_custkey) mean FROM orders", cardinality="exactly_one")
    add("agg_group", b.aggregate(orders("o"), {"o_orderstatus": "@o.o_orderstatus", "o_orderpriority": "@o.o_orderpriority"}, scope="a", n="count", s=("sum", "@o.o_custkey")),
        "SELECT o_orderstatus, o_orderpriority, count(*) n, sum(o_custkey)::BIGINT s FROM orders GROUP BY ALL", "a.o_orderstatus", "a.o_orderpriority")
    add("agg_group_expr", b.aggregate(orders("o"), {"bucket": b.div("@o.o_orderkey", 1000)}, scope="a", n="count", hi=("max", "@o.o_totalprice")), "SELECT o_orderkey // 1000 bucket, count(*) n, max(o_totalprice) hi FROM orders GROUP BY 1", "a.bucket")
    add("agg_having", b.where(b.aggregate(orders("o"), {"o_custkey": "@o.o_custkey"}, scope="a", n="count"), b.gt("@a.n", 12)), "SELECT o_custkey, count(*) n FROM orders GROUP BY 1 HAVING count(*) > 12", "a.o_custkey")
    add("agg_count_arg", b.aggregate(padded(), {"seg": "@p.seg"}, scope="a", n="count", known=("count", "@p.bal")), f"SELECT seg, count(*) n, count(bal) known FROM {padded_sql} GROUP BY 1", "a.seg")
    add("agg_empty", b.aggregate(b.where(orders("o"), b.lt("@o.o_orderkey", 0)), scope="a", n="count", s=("sum", "@o.o_custkey"), lo=("min", "@o.o_orderstatus"), mean=("avg", "@o.o_totalprice")),
        "SELECT count(*) n, sum(o_custkey)::BIGINT s, min(o_orderstatus) lo, avg(o_totalprice) mean FROM orders WHERE o_orderkey < 0", cardinality="exactly_one")
    add("agg_min_max_text", b.aggregate(b.project(part(), ["p"], scope="w", big=b.gt("@p.p_size", 25)), {"p_brand": "@w.p_brand"}, scope="a", lo=("min", "@w.p_name"), hi=("max", "@w.p_name"), any_big=("max", "@w.big")),
        "SELECT p_brand, min(p_name) lo, max(p_name) hi, max(p_size > 25) any_big FROM part GROUP BY 1", "a.p_brand")
    add("agg_sum_exact", b.aggregate(b.rows("r", {"v": "int64"}, [(9223372036854775807,), (1,), (-1,)]), scope="a", s=("sum", "@r.v")), "SELECT 9223372036854775807::BIGINT s", cardinality="exactly_one")
    add("agg_sum_float", b.aggregate(lineitem("l"), {"l_returnflag": "@l.l_returnflag"}, scope="a", q=("sum", "@l.l_quantity"), mean=("avg", "@l.l_quantity")),
        "SELECT l_returnflag, sum(l_quantity) q, avg(l_quantity) mean FROM lineitem GROUP BY 1", "a.l_returnflag")
    add("agg_keys_only", b.aggregate(orders("o"), {"o_orderpriority": "@o.o_orderpriority"}, scope="a"), "SELECT DISTINCT o_orderpriority FROM orders", "a.o_orderpriority")
    add("distinct_rows", b.distinct(b.project(orders("o"), scope="d", o_orderstatus="@o.o_orderstatus", o_orderpriority="@o.o_orderpriority")), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "d.o_orderstatus", "d.o_orderpriority")

    # Set operations --------------------------------------------------------------------------------
    left = lambda: b.project(customer("c"), k="@c.c_nationkey")
    right = lambda: b.project(b.where(b.scan("supplier", "s"), b.gt("@s.s_acctbal", 0.0)), k="@s.s_nationkey")
    ls, rs = "SELECT c_nationkey::BIGINT k FROM customer", "SELECT s_nationkey::BIGINT k FROM supplier WHERE s_acctbal > 0"
    add("union_all", b.concatenate("u", left(), right()), f"{ls} UNION ALL {rs}", "u.k")
    add("union_distinct", b.distinct(b.concatenate("u", left(), right())), f"{ls} UNION {rs}", "u.k")
    for word, of, sql in (("intersect", b.intersect, "INTERSECT"), ("except", b.except_, "EXCEPT")):
        add(f"{word}_all", of("u", left(), right(), "all"), f"{ls} {sql} ALL {rs}", "u.k")
    add("intersect_distinct", b.intersect("u", left(), right()), f"{ls} INTERSECT {rs}", "u.k")
    add("except_distinct", b.except_("u", left(), b.project(b.where(b.scan("supplier", "s"), b.lt("@s.s_nationkey", 12)), k="@s.s_nationkey")), f"{ls} EXCEPT SELECT s_nationkey::BIGINT k FROM supplier WHERE s_nationkey < 12", "u.k")

    # Order and slices ------------------------------------------------------------------------------
    priced = lambda: Rel(kind="order", input=orders("o"), terms=[{"expr": c("o.o_totalprice"), "desc": True}])
    add("order_slice", b.project(b.slice_(priced(), 25), k="@o.o_orderkey", v="@o.o_totalprice"), "SELECT o_orderkey k, o_totalprice v FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
    add("order_slice_offset", b.project(b.slice_(priced(), 10, 40), k="@o.o_orderkey", v="@o.o_totalprice"), "SELECT o_orderkey k, o_totalprice v FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 40")
    add("order_nulls_first", b.slice_(Rel(kind="order", input=padded(), terms=[{"expr": c("p.bal")}, {"expr": c("p.k")}]), 30), f"SELECT k, bal, seg FROM {padded_sql} ORDER BY bal ASC NULLS FIRST, k LIMIT 30")
    add("slice_limit_zero", b.project(b.slice_(priced(), 0), k="@o.o_orderkey"), "SELECT o_orderkey k FROM orders WHERE false")
    add("root_first", b.project(priced(), k="@o.o_orderkey"), "SELECT o_orderkey k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1", cardinality="first")
    add("root_scalar", b.aggregate(orders("o"), scope="a", n="count"), "SELECT count(*) n FROM orders", cardinality="scalar")

    # Bindings and crossings ------------------------------------------------------------------------
    spend = b.aggregate(orders("o"), {"o_custkey": "@o.o_custkey"}, n="count", top=("max", "@o.o_totalprice"))
    add("binding_shared", b.project(b.where(b.join(b.ref("spend", "a"), b.ref("spend", "z"), b.and_(b.eq("@a.n", "@z.n"), b.lt("@a.o_custkey", "@z.o_custkey"))), b.gt("@a.n", 17)), a="@a.o_custkey", z="@z.o_custkey", n="@a.n"),
        "WITH s AS (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) SELECT a.o_custkey a, z.o_custkey z, a.n FROM s a JOIN s z ON a.n = z.n AND a.o_custkey < z.o_custkey WHERE a.n > 17", "a.o_custkey", "z.o_custkey", spend=spend)
    dearest = b.slice_(Rel(kind="order", input=orders("o"), terms=[{"expr": c("o.o_totalprice"), "desc": True}]), 50)
    add("binding_plan_sensitive", b.aggregate(b.join(b.ref("dearest", "a"), b.ref("dearest", "z"), b.eq("@a.o_orderkey", "@z.o_orderkey")), scope="t", n="count", lo=("min", "@a.o_orderkey"), hi=("max", "@z.o_orderkey")),
        "WITH d AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) SELECT count(*) n, min(o_orderkey) lo, max(o_orderkey) hi FROM d", dearest=dearest)
    mine = lambda s="o": b.where(b.scan("orders", s), b.eq(f"@{s}.o_custkey", "@c.c_custkey"))
    count = lambda of, s: b.scalar(b.aggregate(of, scope=s, n="count"))
    add("cross_scalar_count", b.project(customer("c"), k="@c.c_custkey", n=count(mine(), "m")), "SELECT c_custkey k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) n FROM customer", "c.c_custkey")
    add("cross_exists_project", b.project(customer("c"), k="@c.c_custkey", big=b.exists(b.where(mine(), b.gt("@o.o_totalprice", 300000.0)))),
        "SELECT c_custkey k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) big FROM customer", "c.c_custkey")
    best = lambda: b.project(Rel(kind="order", input=mine(), terms=[{"expr": c("o.o_totalprice"), "desc": True}]), k="@o.o_orderkey", v="@o.o_totalprice")
    add("cross_first", b.project(b.project(customer("c"), scope="p", k="@c.c_custkey", best=b.first(best())), k="@p.k", none=b.is_null("@p.best")),
        "SELECT c_custkey k, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) none FROM customer", "p.k")
    add("cross_first_row", b.project(customer("c"), k="@c.c_custkey", best=b.first(best())),
        "SELECT c_custkey k, (SELECT {'k': o_orderkey, 'v': o_totalprice} FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) best FROM customer", "c.c_custkey")
    add("cross_first_value", b.project(customer("c"), k="@c.c_custkey", v=b.scalar(b.project(b.slice_(b.project(Rel(kind="order", input=mine(), terms=[{"expr": c("o.o_totalprice"), "desc": True}]), scope="w", v="@o.o_totalprice"), 1), v="@w.v"))),
        "SELECT c_custkey k, (SELECT o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) v FROM customer", "c.c_custkey")
    add("cross_in_filter", b.project(b.where(customer("c"), b.gt(count(mine(), "m"), 12)), k="@c.c_custkey"), "SELECT c_custkey k FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 12", "c.c_custkey")
    add("cross_in_group", b.aggregate(customer("c"), {"n": count(mine(), "m")}, scope="a", customers="count"), "SELECT n, count(*) customers FROM (SELECT (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) n FROM customer) GROUP BY 1", "a.n")
    add("cross_in_order", b.slice_(b.project(Rel(kind="order", input=customer("c"), terms=[{"expr": count(mine(), "m"), "desc": True}]), k="@c.c_custkey"), 20),
        "SELECT c_custkey k FROM customer ORDER BY (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) DESC, c_custkey LIMIT 20")
    add("cross_as_agg_arg", b.aggregate(customer("c"), {"c_mktsegment": "@c.c_mktsegment"}, scope="a", n=("sum", count(mine(), "m"))),
        "SELECT c_mktsegment, count(*) n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1", "a.c_mktsegment")
    add("cross_ineq", b.project(nation("n"), k="@n.n_nationkey", below=count(b.where(b.scan("supplier", "s"), b.lt("@s.s_nationkey", "@n.n_nationkey")), "m")),
        "SELECT n_nationkey::BIGINT k, (SELECT count(*) FROM supplier WHERE s_nationkey < n_nationkey) below FROM nation", "n.n_nationkey")
    add("cross_mixed", b.project(customer("c"), k="@c.c_custkey", n=count(b.where(mine(), b.gt("@o.o_totalprice", b.mul("@c.c_acctbal", 20.0))), "m")),
        "SELECT c_custkey k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 20) n FROM customer", "c.c_custkey")
    add("cross_over_slice", b.project(customer("c"), k="@c.c_custkey", n=count(b.slice_(Rel(kind="order", input=mine(), terms=[{"expr": c("o.o_orderkey")}]), 3, 1), "m")),
        "SELECT c_custkey k, least(3, greatest(0, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) - 1)) n FROM customer", "c.c_custkey")
    add("cross_uncorrelated", b.project(nation("n"), k="@n.n_nationkey", n=count(region("r"), "m"), any=b.exists(region("r2"))), "SELECT n_nationkey::BIGINT k, (SELECT count(*) FROM region) n, true AS any FROM nation", "n.n_nationkey")
    in_nation = lambda: b.where(customer("c"), b.eq("@c.c_nationkey", "@n.n_nationkey"))
    add("cross_nested", b.project(nation("n"), k="@n.n_nationkey", n=b.scalar(b.aggregate(in_nation(), scope="m", n=("sum", count(mine(), "w"))))),
        "SELECT n_nationkey::BIGINT k, (SELECT count(*) FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) n FROM nation", "n.n_nationkey")
    rich = b.where(b.scan("orders", "o"), b.and_(b.eq("@o.o_custkey", "@c.c_custkey"), b.gt("@o.o_totalprice", b.mul("@n.n_nationkey", 10000))))
    rich["predicate"]["right"]["right"] = b.mul(b.cast("@n.n_nationkey", "float64"), 10000.0)
    add("cross_skip_level", b.project(nation("n"), k="@n.n_nationkey", n=b.scalar(b.aggregate(b.where(in_nation(), b.exists(rich)), scope="m", n="count"))),
        "SELECT n_nationkey::BIGINT k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > n_nationkey * 10000.0)) n FROM nation", "n.n_nationkey")
    names = lambda: b.project(Rel(kind="order", input=b.where(nation("n"), b.eq("@n.n_regionkey", "@r.r_regionkey")), terms=[{"expr": c("n.n_name")}]), n_name="@n.n_name")
    add("cross_array", b.project(region("r"), r_name="@r.r_name", nations=b.array(names())),
        "SELECT r_name, list({'n_name': n_name} ORDER BY n_name) nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1", "r.r_name")

    # Recursion -------------------------------------------------------------------------------------
    parent = b.div(b.sub("@n.n_nationkey", 1), 2)
    step = lambda **more: b.project(b.join(b.where(nation("n"), b.gt("@n.n_nationkey", 0)), b.recursive_ref("tree", "t"), b.eq(parent, "@t.k")), k="@n.n_nationkey", **more)
    root = lambda **more: b.project(b.where(b.scan("nation", "z"), b.eq("@z.n_nationkey", 0)), k="@z.n_nationkey", **more)
    add("recursive_depth", b.project(b.ref("tree", "x"), ["x"]),
        "WITH RECURSIVE t(k, depth) AS (SELECT 0::BIGINT, 0::BIGINT UNION ALL SELECT n_nationkey::BIGINT, depth + 1 FROM nation JOIN t ON (n_nationkey - 1) // 2 = k WHERE n_nationkey > 0) SELECT * FROM t", "x.k", tree=(root(depth=0), step(depth=b.add("@t.depth", 1)), "all"))
    add("recursive_reach", b.project(b.ref("tree", "x"), ["x"]), "SELECT n_nationkey::BIGINT k FROM nation", "x.k", tree=(root(), step(), "new"))
    edges = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 0)]
    hop = b.project(b.join(b.rows("e", {"a": "int64", "z": "int64"}, edges), b.recursive_ref("reach", "t"), b.eq("@e.a", "@t.k")), k="@e.z")
    add("recursive_diamond", b.project(b.ref("reach", "x"), ["x"]), "SELECT * FROM (VALUES (0::BIGINT), (1), (2), (3), (4)) t(k)", "x.k", reach=(b.rows("s", {"k": "int64"}, [(0,), (0,)]), hop, "new"))

    # Published workloads, restated on generated rows -------------------------------------------------
    add("category_revenue", b.aggregate(b.join(lineitem("l"), part(), b.eq("@l.l_partkey", "@p.p_partkey")), {"p_type": "@p.p_type"}, scope="a", n="count", revenue=("sum", b.mul(b.cast("@l.l_extendedprice", "int64"), b.cast("@l.l_quantity", "int64")))),
        "SELECT p_type, count(*) n, sum(trunc(l_extendedprice)::BIGINT * trunc(l_quantity)::BIGINT)::BIGINT revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1", "a.p_type")
    add("customer_order_summary", b.slice_(Rel(kind="order", input=b.aggregate(b.join(customer("c"), orders("o"), b.eq("@c.c_custkey", "@o.o_custkey")), {"c_custkey": "@c.c_custkey", "c_name": "@c.c_name"}, scope="a", n="count", top=("max", "@o.o_totalprice")), terms=[{"expr": c("a.n"), "desc": True}]), 25),
        "SELECT c_custkey, c_name, count(*) n, max(o_totalprice) top FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2 ORDER BY n DESC, c_custkey, c_name LIMIT 25")
    add("orders_page", b.slice_(b.project(Rel(kind="order", input=b.where(orders("o"), b.eq("@o.o_orderstatus", "F")), terms=[{"expr": c("o.o_orderdate"), "desc": True}]), k="@o.o_orderkey", t="@o.o_orderdate"), 50),
        "SELECT o_orderkey k, epoch_ms(o_orderdate) t FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
    replies = b.project(b.join(b.scan("conversations", "m"), b.recursive_ref("thread", "t"), b.and_(b.eq("@m.conv_id", "@t.conv_id"), b.eq("@m.turn", b.add("@t.turn", 1)))), conv_id="@m.conv_id", turn="@m.turn", depth=b.add("@t.depth", 1))
    opening = b.project(b.where(b.scan("conversations", "s"), b.eq("@s.turn", 0)), conv_id="@s.conv_id", turn="@s.turn", depth=0)
    add("threads_depth", b.aggregate(b.ref("thread", "x"), {"conv_id": "@x.conv_id"}, scope="a", posts="count", depth=("max", "@x.depth")),
        "WITH RECURSIVE t(conv_id, turn, depth) AS (SELECT conv_id, turn, 0::BIGINT FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, depth + 1 FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn + 1) SELECT conv_id, count(*) posts, max(depth) depth FROM t GROUP BY 1", "a.conv_id", thread=(opening, replies, "all"))
    return q


#: Recursions that are also registered with all their levels as Spark jobs.
ON_SPARK = ("recursive_depth", "recursive_reach", "recursive_diamond", "threads_depth")


def _run(spark: SparkSession, sf_dir: str, wire: dict, **options) -> DataFrame:
    """The query's rows; where its root asks for one, what ``execute`` shapes as one row."""
    found = engine(spark, sf_dir, **options)
    df = found.dataframe(wire)
    kind = wire["root"]["cardinality"]
    if kind == "many":
        return df
    value = found.execute(wire)
    return spark.createDataFrame([(value,)] if kind == "scalar" else [] if value is None else [tuple(value.values())], df.schema)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = _queries()
    out = {name: (lambda spark, sf_dir, wire=wire: _run(spark, sf_dir, wire)) for name, (wire, _) in made.items()}
    out |= {f"{name}_on_spark": (lambda spark, sf_dir, wire=made[name][0]: _run(spark, sf_dir, wire, small=0)) for name in ON_SPARK}
    return out | {name: run for name, (run, _) in PROGRAMS.items()}


def oracle_sql() -> dict[str, str]:
    made = {name: sql for name, (_, sql) in _queries().items()}
    return made | {f"{name}_on_spark": made[name] for name in ON_SPARK} | {name: sql for name, (_, sql) in PROGRAMS.items()}


FLAGSHIP = "category_revenue"
