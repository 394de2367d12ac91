import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from quarrystone import queries as Q
from quarrystone.errors import DialectError, ResolutionError, TypeMismatch
from quarrystone.operators import relational as R
from quarrystone.plans.planner import Planner
from quarrystone.plans.statistics import Statistics
from quarrystone.sources import catalog, tables
from quarrystone.streaming import arriving, load_arriving

SF = "/root/testdata/sf0.001"
CATALOG = "BEGIN\nr\nr.tbl\nk Int\nname String\nv Double\nEND"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, duck, name):
    ours, theirs = Q.queries()[name](spark, SF).toPandas(), duck.execute(Q.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).astype(str).values.tolist()))
    assert rows(ours) == rows(theirs)


def test_string_key_join_is_whole(spark, duck):
    expected = duck.execute("SELECT SUM(n * n) FROM (SELECT COUNT(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name)").fetchone()[0]
    assert Q.queries()["join_string_key"](spark, SF).count() == expected


def test_block_join(spark, monkeypatch):
    monkeypatch.setattr(R, "SPAN", 64)
    monkeypatch.setattr(R, "BLOCK", 5)
    a = spark.createDataFrame([(i if i % 9 else None, [None, "x", "y", f"z{i}"][i % 4], float(i % 7)) for i in range(200)], "`k.1` long, s string, u double")
    b = spark.createDataFrame([(["x", "x", "y", None, "w"][i % 5], i, float(i % 3)) for i in range(150)], "t string, n int, v double")
    for where in ("(s = t)", "(t = s) AND (u > v)", "(s = t) AND (u = v)", "(s = t) AND (u = v OR n < 7)"):
        plain, blocks = R.join(a, b, where), R.join(a, b, where, hint="blocks")
        assert blocks.schema.names == plain.schema.names
        assert sorted(map(repr, blocks.collect())) == sorted(map(repr, plain.collect()))
    assert R.join(a.limit(0), b, "(s = t)", hint="blocks").count() == 0
    with pytest.raises(ValueError, match="blocks"):
        R.join(a, b, "(s < t)", hint="blocks")


def test_string_key_join_is_dealt_evenly(spark, tmp_path):
    rows = spark.range(600).select(F.col("id").alias("p_partkey"), F.lit("one name").alias("p_name"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    joined = Q.queries()["join_string_key"](spark, str(tmp_path))
    tasks = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 600 * 600 and max(tasks) < 600 * 600 / 4


def test_entry(spark):
    assert sorted(map(tuple, E.entry(spark).collect())) == [(255, 0), (295, 3), (304, 2), (361, 1), (529, 4)]


def test_plan_counts_and_pushdown(spark):
    p = Planner(lambda t: spark.read.parquet(f"{SF}/{t}.parquet"), Statistics.tpch())
    plan = p.plan("SELECT SUM (l.l_linenumber), s.s_suppkey FROM part AS p, supplier AS s, lineitem AS l WHERE (p.p_partkey = l.l_partkey) AND (s.s_suppkey = l.l_suppkey) AND (s.s_acctbal > 2500.0) GROUP BY s.s_suppkey")
    assert (plan.selects, plan.joins) == (1, 2) and plan.lines()[0] == "Number of selects: 1"
    text = p.to_dataframe(plan)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(s_acctbal,2500.0)" in text and "l_extendedprice" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize(
    "text,error",
    [
        ("SELECT n.none FROM nation AS n WHERE (n.n_name = 'x')", ResolutionError),
        ("SELECT n.n_name FROM nation AS n WHERE (n.none = 'x')", ResolutionError),
        ("SELECT n_name FROM nation AS a, nation AS b WHERE (a.n_nationkey = b.n_nationkey)", ResolutionError),
        ("SELECT n.n_name FROM nation AS n WHERE (n.n_name = n.n_name) GROUP BY n.n_name", DialectError),
        ("SELECT SUM (n.n_nationkey), n.n_name FROM nation AS n WHERE (n.n_name = n.n_name)", DialectError),
        ("SELECT SUM (n.n_name) FROM nation AS n WHERE (n.n_name = n.n_name)", TypeMismatch),
        ("SELECT n.n_name FROM nation AS n WHERE (n.n_name = 1)", TypeMismatch),
    ],
)
def test_errors(spark, text, error):
    with pytest.raises(error):
        Planner(lambda t: spark.read.parquet(f"{SF}/{t}.parquet")).run(text)


def test_strict_types(spark):
    df = spark.createDataFrame([(1.5,)], "a double")
    assert R.select(df, "(a > 1)").count() == 1
    with pytest.raises(TypeMismatch):
        R.select(df, "(a > 1)", strict_types=True)


def test_integer_arithmetic(spark):
    df = spark.createDataFrame([(-7, 2), (7, -2), (0, 5)], "a int, b int")
    assert R.total(df, "a / b").first()[0] == -6
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        R.total(spark.createDataFrame([(1, 0)], "a int, b int"), "a / b").collect()


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "a int, b string")
    other = spark.createDataFrame([(1, "x")], "c int, d string")
    assert R.join(none, other, "(a = c)").count() == 0 and R.distinct(none).count() == 0
    assert R.total(none, "a").first()[0] is None and R.group_total(none, ["b"], "a").count() == 0


def test_many_to_many_and_strings(spark):
    a = spark.createDataFrame([("z",), ("z",), ("a",), ("é",)], "s string")
    b = spark.createDataFrame([("z", 1), ("z", 2), ("é", 3)], "t string, v int")
    assert R.join(a, b, "(s = t)").count() == 5
    with pytest.raises(ValueError):
        R.join(a, a, "(s = s)")


def test_tbl_files_and_sorted_tables(spark, tmp_path):
    (tmp_path / "r.tbl").write_text("3|c|1.5|\n||  |\n1|a||\n".replace("  ", ""))
    file, schema = catalog.parse_catalog(CATALOG)["r"]
    loaded = catalog.load_all(spark, {"r": (file, schema)}, str(tmp_path), str(tmp_path / "db"), tables.load_tbl)["r"]
    assert sorted(map(tuple, loaded.collect())) == [(0, "", 0.0), (1, "a", 0.0), (3, "c", 1.5)]
    path = str(tmp_path / "sorted")
    tables.create_sorted(loaded, path, ["k"])
    assert tables.order_of(spark, path) == ["k"]
    tables.insert(spark.createDataFrame([(2, "b", 0.5)], schema), path)
    again = tables.open_table(spark, path)
    assert again.count() == 4 and tables.order_of(spark, path) == ["k"] and R.out_of_order(R.sort(again, ["k"]), ["k"]) == 0
    assert tables.order_of(spark, str(tmp_path / "db" / "r")) is None
    tables.insert(loaded, str(tmp_path / "db" / "r"))
    tables.write_out(loaded, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())[2] == "k:[3],name:[c],v:[1.500000]"
    assert tables.drain(loaded, F.col("k")) == (3, 4)
    with pytest.raises(DialectError):
        catalog.parse_catalog("BEGIN\nr\nr.tbl\nk Date\nEND")
    assert catalog.read_settings("a\nb\nc\n") == ("a", "b", "c")


def test_unsorted_is_noticed(spark):
    assert R.out_of_order(spark.createDataFrame([(3,), (1,), (2,)], "a int").coalesce(1), ["a"]) == 1


def test_stream_into_a_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (5, "b")], "k int, name string")
    rows.write.parquet(str(tmp_path / "in"))
    tables.create_sorted(rows.limit(0), str(tmp_path / "table"), ["k"])
    load_arriving(arriving(spark, str(tmp_path / "in"), rows.schema, "(k > 2)"), str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in tables.open_table(spark, str(tmp_path / "table")).collect()] == [(5, "b")]


def test_measured_statistics(spark):
    s = Statistics()
    s.add_frame("nation", spark.read.parquet(f"{SF}/nation.parquet"))
    assert s.relations["nation"].size == 25 and s.relations["nation"].distinct["n_regionkey"] == 5


def test_order_is_checked_by_first_and_last_rows(spark):
    parts = spark.createDataFrame([(5,), (1,)], "a int").coalesce(1).union(spark.createDataFrame([(2,)], "a int").coalesce(1))
    assert R.out_of_order(parts, ["a"]) == 1 and R.out_of_order(parts.limit(0), ["a"]) == 0


@pytest.mark.parametrize("name", ["sort_single", "sort_multi", "sort_check"])
def test_order_rows_notice_a_missing_sort(spark, duck, monkeypatch, name):
    monkeypatch.setattr(R, "sort", lambda df, order, within_partitions=False: df)
    ours, theirs = Q.queries()[name](spark, SF).toPandas(), duck.execute(Q.oracle_sql()[name]).df()
    assert sorted(map(str, ours[sorted(ours)].values.tolist())) != sorted(map(str, theirs[sorted(ours)].values.tolist()))


def test_a_lost_writer_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.create_sorted(spark.range(5), path, ["id"])
    os.rename(path, path + ".replaced")
    assert tables.open_table(spark, path).count() == 5 and tables.order_of(spark, path) == ["id"]


@pytest.mark.parametrize("keys", [None, ["id"]])
def test_a_batch_counts_once(spark, tmp_path, keys):
    path = str(tmp_path / "t")
    tables.create_sorted(spark.range(2), path, keys) if keys else tables.create_heap(spark.range(2), path)
    for batch in (0, 0, 1, 1, 0):
        tables.insert(spark.range(3), path, batch)
    assert tables.open_table(spark, path).count() == 8
