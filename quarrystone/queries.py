"""One query per relational operator, with the same in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import relational as R
from .plans.planner import Planner
from .plans.statistics import Statistics
from .sources import tables as S
from .sources.catalog import parse_catalog

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, sql: str | None, query: Query) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def _on(table: str, step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: step(_table(spark, d, table))


def _both(left: str, right: str, step: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: step(_table(spark, d, left), _table(spark, d, right))


def _dialect(text: str, **how: object) -> Query:
    return lambda spark, d: Planner(lambda t: _table(spark, d, t), Statistics.tpch(), **how).run(text)


def _placed(df: DataFrame, *first: str) -> DataFrame:
    """The rows' places as a column, for comparisons that ignore order: places follow partitions and rows as they stand, whatever
    the keys. One task numbers all rows: small tables only."""
    held = df.withColumn("_at", F.monotonically_increasing_id())
    return held.withColumn("place", F.row_number().over(Window.orderBy(*first, "_at")).cast("long")).drop("_at", *first)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """A stored table's rows with their places in its files, which are in order of their names."""
    return _placed(S.open_table(spark, path).withColumn("_file", F.input_file_name()), "_file")


def _path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quarrystone-")
    return f"{root.rstrip('/')}/quarrystone-tables/{name}-{uuid.uuid4().hex}"


def _tbl(df: DataFrame, path: str) -> str:
    """df as text with `|` after each field, nulls as empty ones."""
    df.select(F.concat(*[F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|")) for c in df.columns]).alias("line")).write.text(path)
    return path


# Scans and filters

_add("scan_heap", "SELECT * FROM region", _on("region", lambda t: t))
_add("select_file", "SELECT * FROM supplier WHERE s_acctbal > 2500.0", lambda spark, d: R.select_file(spark, f"{d}/supplier.parquet", "(s_acctbal > 2500.0)"))
_add(
    "scan_filter_cnf",
    "SELECT * FROM lineitem WHERE l_shipdate > TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-01-20' AND l_discount > 0.04 AND l_discount < 0.07 AND l_quantity = 4",
    _on("lineitem", lambda t: R.select(t, "(l_shipdate > '1996-01-01') AND (l_shipdate < '1996-01-20') AND (l_discount > 0.04) AND (l_discount < 0.07) AND (l_quantity = 4.0)")),
)
_add("filter_cnf_or", "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND (l_discount < 0.04 OR l_linestatus = 'F')", _on("lineitem", lambda t: R.select(t, "(l_returnflag = 'R') AND (l_discount < 0.04 OR l_linestatus = 'F')")))
_add("filter_string_compare", "SELECT * FROM region WHERE r_name < 'middle east' AND r_regionkey > 1", _on("region", lambda t: R.select(t, "(r_name < 'middle east') AND (r_regionkey > 1)")))
_add("filter_literal_left", "SELECT * FROM nation WHERE 10 < n_nationkey", _on("nation", lambda t: R.select(t, "(10 < n_nationkey)")))
_add("filter_literals_only", "SELECT * FROM region WHERE 1 < 2", _on("region", lambda t: R.select(t, "(1 < 2)")))
_add("filter_tautology", "SELECT * FROM supplier WHERE s_suppkey = s_suppkey", _on("supplier", lambda t: R.select(t, "(s_suppkey)")))
_add("filter_int_double", "SELECT * FROM customer WHERE c_acctbal > 9000", _on("customer", lambda t: R.select(t, "(c_acctbal > 9000)")))
_add("project", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice > 931.01 AND p_retailprice < 931.3", _on("part", lambda t: R.project(R.select(t, "(p_retailprice > 931.01) AND (p_retailprice < 931.3)"), 0, "p_name", "p_retailprice")))

# Joins

_add("join_equi", "SELECT s_suppkey, s_name, l_orderkey, l_linenumber, l_extendedprice FROM supplier, lineitem WHERE s_suppkey = l_suppkey", _both("supplier", "lineitem", lambda a, b: R.project(R.join(a, b, "(s_suppkey = l_suppkey)"), "s_suppkey", "s_name", "l_orderkey", "l_linenumber", "l_extendedprice")))
_add("join_equi_residual", "SELECT o_orderkey, o_totalprice, l_linenumber, l_extendedprice FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_quantity > 40 AND o_totalprice < l_extendedprice", _both("orders", "lineitem", lambda a, b: R.project(R.join(a, b, "(o_orderkey = l_orderkey) AND (l_quantity > 40.0) AND (o_totalprice < l_extendedprice)"), "o_orderkey", "o_totalprice", "l_linenumber", "l_extendedprice")))
_add("join_multi_key", "SELECT s_suppkey, c_custkey FROM supplier, customer WHERE s_nationkey = c_nationkey AND s_suppkey = c_custkey", _both("supplier", "customer", lambda a, b: R.project(R.join(a, b, "(s_nationkey = c_nationkey) AND (s_suppkey = c_custkey)"), "s_suppkey", "c_custkey")))
_add("join_string_key", "SELECT a.p_partkey, b.p_partkey AS q_partkey FROM part a, part b WHERE a.p_name = b.p_name", _on("part", lambda t: R.project(R.join(t.select("p_partkey", "p_name"), t.select(F.col("p_partkey").alias("q_partkey"), F.col("p_name").alias("q_name")), "(p_name = q_name)", hint="blocks"), "p_partkey", "q_partkey")))
_add("join_sort_merge", "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders, customer WHERE o_custkey = c_custkey", _both("orders", "customer", lambda a, b: R.project(R.join(a, b, "(o_custkey = c_custkey)", hint="merge"), "o_orderkey", "c_custkey", "c_mktsegment")))
_add("join_theta", "SELECT * FROM nation, region WHERE n_nationkey < r_regionkey", _both("nation", "region", lambda a, b: R.join(a, b, "(n_nationkey < r_regionkey)")))
_add("join_cross", "SELECT * FROM region, nation", _both("region", "nation", lambda a, b: R.join(a, b)))
_add("join_self_alias", "SELECT n1.n_name AS n1_n_name, n2.n_name AS n2_n_name FROM nation n1, nation n2 WHERE n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey < n2.n_nationkey", _dialect("SELECT n1.n_name, n2.n_name FROM nation AS n1, nation AS n2 WHERE (n1.n_regionkey = n2.n_regionkey) AND (n1.n_nationkey < n2.n_nationkey)"))
_add("join_three_way", "SELECT CAST(SUM(l.l_linenumber) AS BIGINT) AS sum FROM part p, supplier s, lineitem l WHERE p.p_partkey = l.l_partkey AND s.s_suppkey = l.l_suppkey AND s.s_acctbal > 2500.0", _dialect("SELECT SUM (l.l_linenumber) FROM part AS p, supplier AS s, lineitem AS l WHERE (p.p_partkey = l.l_partkey) AND (s.s_suppkey = l.l_suppkey) AND (s.s_acctbal > 2500.0)"))

# Sums and duplicates; doubles are rounded on both sides, as their sums depend on the order


def _rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.withColumn("sum", F.round("sum", digits))


_add("sum_int", "SELECT CAST(SUM(n_nationkey) AS BIGINT) AS sum FROM nation", _on("nation", lambda t: R.total(t, "n_nationkey")))
_add("sum_double", "SELECT ROUND(SUM(s_acctbal), 2) AS sum FROM supplier", _on("supplier", lambda t: _rounded(R.total(t, "s_acctbal"))))
_add("sum_expr", "SELECT ROUND(SUM(s_acctbal + (s_acctbal * 1.05)), 2) AS sum FROM supplier", _on("supplier", lambda t: _rounded(R.total(t, "(s_acctbal + (s_acctbal * 1.05))"))))
_add("sum_int_division", "SELECT CAST(SUM(CAST(n_nationkey AS BIGINT) // 7) AS BIGINT) AS sum FROM nation", _on("nation", lambda t: R.total(t, "n_nationkey / 7")))
_add("sum_double_division", "SELECT ROUND(SUM(p_retailprice / p_size), 2) AS sum FROM part", _on("part", lambda t: _rounded(R.total(t, "p_retailprice / p_size"))))
_add("sum_unary_minus", "SELECT CAST(SUM(-(n_nationkey + 3)) AS BIGINT) AS sum FROM nation", _on("nation", lambda t: R.total(t, "- (n_nationkey + 3)")))
_add("sum_binary_minus", "SELECT CAST(SUM(n_nationkey - (n_regionkey - 3)) AS BIGINT) AS sum FROM nation", _on("nation", lambda t: R.total(t, "n_nationkey - n_regionkey - 3")))
_add("sum_negative_division", "SELECT CAST(SUM(CAST(trunc((n_nationkey - 12) / 5.0) AS BIGINT)) AS BIGINT) AS sum FROM nation WHERE n_nationkey < 20", _on("nation", lambda t: R.total(R.select(t, "(n_nationkey < 20)"), "(n_nationkey - 12) / 5")))
_add("sum_right_assoc", "SELECT CAST(SUM(n_nationkey * (n_regionkey + 2)) AS BIGINT) AS sum FROM nation", _on("nation", lambda t: R.total(t, "n_nationkey * n_regionkey + 2")))
_add("sum_precedence", "SELECT CAST(SUM(n_nationkey * n_regionkey + 2) AS BIGINT) AS sum FROM nation", _on("nation", lambda t: R.total(t, "n_nationkey * n_regionkey + 2", precedence="standard")))
_add("sum_empty", "SELECT CAST(SUM(n_nationkey) AS BIGINT) AS sum FROM nation WHERE n_nationkey > 1000", _on("nation", lambda t: R.total(R.select(t, "(n_nationkey > 1000)"), "n_nationkey")))
_add("group_by_sum", "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS sum, s_nationkey FROM supplier, lineitem WHERE s_suppkey = l_suppkey GROUP BY s_nationkey", _both("supplier", "lineitem", lambda a, b: R.group_total(R.join(a, b, "(s_suppkey = l_suppkey)"), ["s_nationkey"], "l_linenumber")))
_add("group_by_multi", "SELECT ROUND(SUM(l_quantity), 2) AS sum, l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus", _on("lineitem", lambda t: _rounded(R.group_total(t, ["l_returnflag", "l_linestatus"], "l_quantity"))))
_add("distinct_rows", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_extendedprice < 2000", _on("lineitem", lambda t: R.distinct(R.project(R.select(t, "(l_extendedprice < 2000.0)"), "l_suppkey"))))
_add("distinct_attributes", "SELECT DISTINCT c.c_mktsegment, c.c_nationkey FROM customer c WHERE c.c_acctbal > 0", _dialect("SELECT DISTINCT c.c_mktsegment, c.c_nationkey FROM customer AS c WHERE (c.c_acctbal > 0.0)"))
_add("sum_distinct_std", "SELECT CAST(SUM(DISTINCT n_regionkey) AS BIGINT) AS sum FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation)", _on("nation", lambda t: R.total(t.union(t), "n_regionkey", distinct_values=True)))
_add("sum_distinct_compat", "SELECT CAST(SUM(n_nationkey) AS BIGINT) AS sum, n_regionkey FROM nation GROUP BY n_regionkey", _on("nation", lambda t: R.group_total(t.union(t), ["n_regionkey"], "n_nationkey", distinct_rows=True)))
_add("drain", "SELECT COUNT(*) AS n, CAST(SUM(n_nationkey) AS BIGINT) AS s FROM nation", lambda spark, d: spark.createDataFrame([S.drain(_table(spark, d, "nation"), F.col("n_nationkey"))], "n long, s long"))

# Order and stored tables

_add("sort_single", "SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS place FROM supplier", _on("supplier", lambda t: _placed(R.sort(R.project(t, "s_suppkey", "s_acctbal"), "(s_acctbal) AND (s_suppkey)"))))
_add("sort_multi", "SELECT c_custkey, c_mktsegment, c_nationkey, row_number() OVER (ORDER BY c_mktsegment, c_nationkey, c_custkey) AS place FROM customer", _on("customer", lambda t: _placed(R.sort(R.project(t, "c_custkey", "c_mktsegment", "c_nationkey"), ["c_mktsegment", "c_nationkey", "c_custkey"]))))
_add(
    "sort_check",
    "SELECT CAST(0 AS BIGINT) AS wrong, (SELECT COUNT(*) - 1 FROM nation) AS reversed",
    lambda spark, d: spark.createDataFrame(
        [(R.out_of_order(R.sort(_table(spark, d, "orders"), "(o_custkey) AND (o_orderkey)"), "(o_custkey) AND (o_orderkey)"), R.out_of_order(_table(spark, d, "nation").orderBy(F.desc("n_nationkey")), ["n_nationkey"]))], "wrong long, reversed long"
    ),
)
_add("sorted_file_merge", "SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS place FROM supplier", _on("supplier", lambda t: _placed(S.merge_sorted(R.project(R.select(t, "(s_suppkey < 5)"), "s_suppkey", "s_acctbal"), R.project(R.select(t, "(s_suppkey > 4)"), "s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"]))))


def _loaded(spark: SparkSession, d: str, keys: list[str] | None) -> str:
    rows = _table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 > 0, F.col("s_name")).alias("s_name"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_acctbal")).alias("s_acctbal"))
    path = _path(spark, "loaded")
    S.load_tbl(spark, _tbl(rows, _path(spark, "text")), rows.schema, path, keys)
    return path


def _inserted(spark: SparkSession, d: str, keys: list[str] | None) -> str:
    rows, path = _table(spark, d, "customer").select("c_custkey", "c_acctbal"), _path(spark, "inserted")
    some = R.select(rows, "(c_acctbal < 3000.0)")
    S.create_sorted(some, path, keys) if keys else S.create_heap(some, path)
    for rest in ("(c_acctbal > 6000.0)", "(c_acctbal > 2999.999) AND (c_acctbal < 6000.001)"):
        S.insert(R.select(rows, rest), path)
    return path


_LOADED = "SELECT s_suppkey, CASE WHEN s_suppkey % 7 > 0 THEN s_name ELSE '' END AS s_name, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal ELSE 0.0 END AS s_acctbal FROM supplier"
_add("tbl_load_heap", _LOADED, lambda spark, d: S.open_table(spark, _loaded(spark, d, None)))
_add("tbl_load_sorted", f"SELECT *, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS place FROM ({_LOADED})", lambda spark, d: _stored(spark, _loaded(spark, d, ["s_acctbal", "s_suppkey"])))
_add("heap_insert", "SELECT c_custkey, c_acctbal FROM customer", lambda spark, d: S.open_table(spark, _inserted(spark, d, None)))
_add("sorted_insert", "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer", lambda spark, d: _stored(spark, _inserted(spark, d, ["c_acctbal", "c_custkey"])))
_add("sorted_order", "SELECT * FROM (VALUES (1, 'c_acctbal'), (2, 'c_custkey')) t(nth, attribute)", lambda spark, d: spark.createDataFrame([*enumerate(S.order_of(spark, _inserted(spark, d, ["c_acctbal", "c_custkey"])), 1)], "nth int, attribute string"))
_add("write_out_format", "SELECT 'n_nationkey:[' || n_nationkey || '],n_name:[' || n_name || '],n_regionkey:[' || n_regionkey || ']' AS line FROM nation", _on("nation", S.lines))
_add("print_format", "SELECT 'r_regionkey: [' || r_regionkey || '], r_name: [' || r_name || ']' AS line FROM region", _on("region", S.printed))
_add("compose_records", "SELECT * FROM (VALUES (1, 'a', 0.5), (2, 'b', 1.5)) t(k, name, v)", lambda spark, _: S.compose(spark, [(1, "a", 0.5), (2, "b", 1.5)], parse_catalog("BEGIN\nt\nt.tbl\nk Int\nname String\nv Double\nEND")["t"][1]))
_SQL["compose_records"] = "SELECT CAST(k AS INTEGER) AS k, name, CAST(v AS DOUBLE) AS v FROM (VALUES (1, 'a', 0.5), (2, 'b', 1.5)) t(k, name, v)"

# The dialect

_CASES = {
    "sql_tc1": ("SELECT n.n_nationkey FROM nation AS n WHERE (n.n_name = 'NATION_9')", "SELECT n_nationkey FROM nation WHERE n_name = 'NATION_9'"),
    "sql_tc2": ("SELECT n.n_name FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_nationkey > 5)", "SELECT n_name FROM nation, region WHERE n_regionkey = r_regionkey AND n_nationkey > 5"),
    "sql_tc3": ("SELECT SUM (n.n_nationkey) FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_name = 'NATION_9')", "SELECT CAST(SUM(n_nationkey) AS BIGINT) AS sum FROM nation, region WHERE n_regionkey = r_regionkey AND n_name = 'NATION_9'"),
    "sql_tc4": ("SELECT SUM (n.n_regionkey) FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_name = 'NATION_9') GROUP BY n.n_regionkey", "SELECT CAST(SUM(n_regionkey) AS BIGINT) AS sum, n_regionkey FROM nation, region WHERE n_regionkey = r_regionkey AND n_name = 'NATION_9' GROUP BY n_regionkey"),
    "sql_tc5": ("SELECT SUM DISTINCT (n.n_nationkey + r.r_regionkey) FROM nation AS n, region AS r, customer AS c WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_nationkey = c.c_nationkey) AND (n.n_nationkey > 10) GROUP BY r.r_regionkey", "SELECT CAST(SUM(DISTINCT n_nationkey + r_regionkey) AS BIGINT) AS sum, r_regionkey FROM nation, region, customer WHERE n_regionkey = r_regionkey AND n_nationkey = c_nationkey AND n_nationkey > 10 GROUP BY r_regionkey"),
    "sql_tc6": ("SELECT SUM (l.l_linenumber), s.s_suppkey FROM part AS p, supplier AS s, lineitem AS l WHERE (p.p_partkey = l.l_partkey) AND (s.s_suppkey = l.l_suppkey) AND (s.s_acctbal > 2500.0) GROUP BY s.s_suppkey", "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS sum, s_suppkey FROM part, supplier, lineitem WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND s_acctbal > 2500.0 GROUP BY s_suppkey"),
}
for _name, (_text, _sql) in _CASES.items():
    _add(_name, _sql, _dialect(_text))
_add("sql_tc5_compat", _CASES["sql_tc5"][1].replace("DISTINCT ", ""), _dialect(_CASES["sql_tc5"][0], compat=True))

_add("sum_distinct_global_compat", "SELECT CAST(SUM(n_regionkey) AS BIGINT) AS sum FROM nation WHERE n_nationkey > 5", _dialect("SELECT SUM DISTINCT (n.n_regionkey) FROM nation AS n WHERE (n.n_nationkey > 5)", compat=True))
FLAGSHIP = _CASES["sql_tc5"][0].replace("DISTINCT ", "")
_add("flagship", _SQL["sql_tc5_compat"], lambda spark, d: flagship(spark, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Planner(lambda t: _table(spark, sf_dir, t), Statistics.tpch()).run(FLAGSHIP)


# Estimates and plans


def estimates() -> list[tuple[str, float]]:
    """A few estimates, each over its own statistics."""
    def over(relations: dict[str, tuple[float, dict[str, float]]]) -> Statistics:
        s = Statistics()
        for name, (size, atts) in relations.items():
            s.add_rel(name, size)
            for a, v in atts.items():
                s.add_att(name, a, v)
        return s

    one = over({"supplier": (10000, {"s_suppkey": 10000}), "partsupp": (800000, {"ps_suppkey": 10000})})
    two = over({"lineitem": (6001215, {"l_returnflag": 3, "l_discount": 11, "l_shipmode": 7})})
    three = over({"part": (200000, {"p_partkey": 200000, "p_size": 50}), "partsupp": (800000, {"ps_partkey": 200000})})
    return [
        ("join", one.estimate("(s_suppkey = ps_suppkey)", ["supplier", "partsupp"])),
        ("or_list", round(two.estimate("(l_returnflag = 'R') AND (l_discount < 0.04 OR l_shipmode = 'MAIL')", ["lineitem"]), 1)),
        ("same_name", round(three.estimate("(p_partkey = ps_partkey) AND (p_size = 3 OR p_size = 6 OR p_size = 19)", ["part", "partsupp"]), 1)),
    ]


_add("stats_estimate", "SELECT * FROM (VALUES ('join', CAST(800000.0 AS DOUBLE)), ('or_list', CAST(857316.4 AS DOUBLE)), ('same_name', CAST(48000.0 AS DOUBLE))) t(name, estimate)", lambda spark, _: spark.createDataFrame(estimates(), "name string, estimate double"))
# The printed plan of sql_tc6.
_PLAN = (
    'Number of selects: 1',
    'Number of joins: 2',
    'SelectFile supplier -> pipe 0 [supplier AS s]',
    '  s.s_suppkey: bigint',
    '  s.s_name: string',
    '  s.s_nationkey: int',
    '  s.s_acctbal: double',
    'SelectPipe pipe 0 -> pipe 1 [(s.s_acctbal > 2500.0)]',
    '  s.s_suppkey: bigint',
    '  s.s_name: string',
    '  s.s_nationkey: int',
    '  s.s_acctbal: double',
    'SelectFile lineitem -> pipe 2 [lineitem AS l]',
    '  l.l_orderkey: bigint',
    '  l.l_partkey: bigint',
    '  l.l_suppkey: bigint',
    '  l.l_linenumber: int',
    '  l.l_quantity: double',
    '  l.l_extendedprice: double',
    '  l.l_discount: double',
    '  l.l_tax: double',
    '  l.l_returnflag: string',
    '  l.l_linestatus: string',
    '  l.l_shipdate: timestamp_ntz',
    'Join pipe 1, pipe 2 -> pipe 3 [(s.s_suppkey = l.l_suppkey)]',
    '  s.s_suppkey: bigint',
    '  s.s_name: string',
    '  s.s_nationkey: int',
    '  s.s_acctbal: double',
    '  l.l_orderkey: bigint',
    '  l.l_partkey: bigint',
    '  l.l_suppkey: bigint',
    '  l.l_linenumber: int',
    '  l.l_quantity: double',
    '  l.l_extendedprice: double',
    '  l.l_discount: double',
    '  l.l_tax: double',
    '  l.l_returnflag: string',
    '  l.l_linestatus: string',
    '  l.l_shipdate: timestamp_ntz',
    'SelectFile part -> pipe 4 [part AS p]',
    '  p.p_partkey: bigint',
    '  p.p_name: string',
    '  p.p_brand: string',
    '  p.p_type: string',
    '  p.p_size: int',
    '  p.p_retailprice: double',
    'Join pipe 3, pipe 4 -> pipe 5 [(p.p_partkey = l.l_partkey)]',
    '  s.s_suppkey: bigint',
    '  s.s_name: string',
    '  s.s_nationkey: int',
    '  s.s_acctbal: double',
    '  l.l_orderkey: bigint',
    '  l.l_partkey: bigint',
    '  l.l_suppkey: bigint',
    '  l.l_linenumber: int',
    '  l.l_quantity: double',
    '  l.l_extendedprice: double',
    '  l.l_discount: double',
    '  l.l_tax: double',
    '  l.l_returnflag: string',
    '  l.l_linestatus: string',
    '  l.l_shipdate: timestamp_ntz',
    '  p.p_partkey: bigint',
    '  p.p_name: string',
    '  p.p_brand: string',
    '  p.p_type: string',
    '  p.p_size: int',
    '  p.p_retailprice: double',
    'GroupBy pipe 5 -> pipe 6 [l.l_linenumber]',
    '  sum: bigint',
    '  s.s_suppkey: bigint',
    'Write pipe 6 -> pipe 7',
    '  sum: bigint',
    '  s.s_suppkey: bigint',
)
_ROWS = ", ".join("({}, '{}')".format(i, x.replace("'", "''")) for i, x in enumerate(_PLAN))
_add("explain_plan", f"SELECT CAST(line AS BIGINT) AS line, text FROM (VALUES {_ROWS}) t(line, text)", lambda spark, d: spark.createDataFrame(list(enumerate(Planner(lambda t: _table(spark, d, t), Statistics.tpch()).plan(_CASES["sql_tc6"][0]).lines())), "line long, text string"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
