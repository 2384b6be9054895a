"""Every registered query against its SQL, plan shapes, and the SQL functions."""

import math
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tamiz.plans.registry import all_oracle_sql, all_queries
from tamiz.functions import logtext as L
from tamiz.functions import personal as P
from tamiz.functions.register import register
from tamiz.operators.ordered import rank_whole, running
from tamiz.plans.base import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_oracle_sql()
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def cell(v):
    return "~" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def test_the_contract_lists_all_of_them():
    assert QUERIES.keys() <= contract.queries().keys() and SQL.keys() <= contract.oracle_sql().keys() and SQL.keys() == QUERIES.keys()


@needs_data
def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for word in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan, word


@needs_data
def test_scans_read_only_what_they_need(spark):
    plan = plan_of(QUERIES["q_shared_suppliers"](spark, FOLDER))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in plan
    filtered = plan_of(QUERIES["q_unreferenced_customers"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(o_totalprice,450000.0\)", filtered)


def test_first_rows_are_limited_before_the_shuffle(spark):
    from tamiz.operators.ordered import first_rows
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    assert plan_of(first_rows(df, ["k"], ["v"], 2)).count("WindowGroupLimit") == 2


def test_one_hot_file_is_spread_over_tasks(spark):
    """A single group is cut into chunks, so its rows end in many partitions."""
    df = spark.range(20000).selectExpr("'one' AS file", "id AS line_no", "CASE WHEN id % 7 = 0 THEN id END AS h")
    out = running(df, ["file"], "line_no", {"head": (F.col("h"), "last"), "least": (F.col("h") + 1, "min")}, chunk=500)
    per_task = out.groupBy(F.spark_partition_id().alias("p")).count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert per_task.count() > 4 and per_task.agg(F.max("count")).first()[0] < 10000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.where("head <> line_no - line_no % 7 OR least <> 1").count() == 0
    ranked = rank_whole(df, ["file"], "line_no", "pos", chunk=500)
    assert ranked.where("pos <> line_no + 1").count() == 0


def test_sql_functions_equal_the_expressions(spark):
    names = register(spark)
    assert "detect_form" in names
    values = ["12345678Z", " X1234567L ", "a@b.es", "612345678", "123456789", "-3,5", "12345678A", "x 10 de 2026-01-01  ", "a \r\n b\n", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    df.createOrReplaceTempView("fv")
    sql = spark.sql("SELECT v, detect_form(v) f, is_plain_number(v) p, control_letter_ok(v) c, error_signature('A', 'B', v) s FROM fv")
    mine = df.select("v", P.detect_form(F.col("v")).alias("f"), P.is_plain_number(F.col("v")).alias("p"), P.control_letter_ok(F.col("v")).alias("c"),
                     L.signature(F.lit("A"), F.lit("B"), F.col("v")).alias("s"))
    assert sorted(map(tuple, sql.collect()), key=str) == sorted(map(tuple, mine.collect()), key=str)
    assert "PythonUDF" not in plan_of(sql)
    from tamiz.functions.bodies import body_signature
    a = [r[0] for r in spark.sql("SELECT body_signature(v) FROM fv ORDER BY v").collect()]
    assert a == [r[0] for r in df.orderBy("v").select(body_signature(F.col("v"))).collect()]


def test_lineage_cut_is_reliable(spark):
    from tamiz.session import durable
    df = durable(spark.range(5))
    assert df.count() == 5 and "FileScan parquet" in plan_of(df) and "Range" not in plan_of(df)
    folder = spark.conf.get("spark.checkpoint.dir")
    assert folder in plan_of(df.select("id")).replace("file:", "")
    root = Path(__file__).resolve().parents[1]
    for path in (root / "tamiz").rglob("*.py"):
        assert ".localCheckpoint(" not in path.read_text() and ".toPandas(" not in path.read_text()


def test_phrases_of_all_customers_are_looked_for(spark, tmp_path):
    """Repeated and null keys of every table, against brute force."""
    orders = [(k, c, p) for k, c, p in zip([1, 1, 2, 3, 4, 4, None, 8, 9, 9, 12, 13], [11, 11, 12, 2, 7, 7, 12, None, 1110, 1110, 1, 99], ["1-URGENT", "1-URGENT", "5-LOW", None] + ["3-MEDIUM"] * 8)]
    customers, nations = [1, 2, 7, 7, 11, 12, 12, 50, 1110, None], [0, 1, 1, None]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(c,) for c in customers], "c_custkey bigint").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(n,) for n in nations], "n_nationkey bigint").write.parquet(str(tmp_path / "nation.parquet"))
    phrases = {f"about customer{c} and" for c in customers if c is not None} | {"customer" + str(n).rjust(4, "1") for n in nations if n is not None}
    want = {}
    for k, c, p in orders:
        for phrase in phrases if c is not None and p is not None else ():
            if phrase in f"note about customer{c} and their order {p}":
                at = ("f" if k is not None and k % 4 else None, None if k is None else k % 3, phrase)
                want[at] = want.get(at, 0) + 1
    got = {(r["file"], r["line_no"], r["phrase"]): r["rows"] for r in QUERIES["q_phrase_repeats_whole"](spark, str(tmp_path)).collect()}
    assert got == want and {"about customer7 and", "about customer12 and", "customer1110"} <= {p for _, _, p in want}


def test_summaries_of_one_group_are_scanned_in_spans(spark):
    """One group of 5,000 chunks: no task of the scan reads 500 summaries."""
    from tamiz.operators import ordered
    df = spark.range(50_000).selectExpr("'one' AS file", "id AS line_no", "CASE WHEN id % 70 = 0 THEN id END AS h")
    out = running(df, ["file"], "line_no", {"head": (F.col("h"), "last"), "least": (F.col("h") + 1, "min")}, chunk=10)
    assert out.where("head <> line_no - line_no % 70 OR least <> 1").count() == 0
    assert rank_whole(df, ["file"], "line_no", "pos", chunk=10).where("pos <> line_no + 1").count() == 0
    cells = df.select(ordered._cell("line_no", 10).alias("chunk")).distinct()
    spans = cells.withColumnRenamed("chunk", "c").select(ordered._cell("c", 10 * ordered.FAN).alias("span"))
    assert cells.count() == 5000 and spans.groupBy("span").count().agg(F.max("count")).first()[0] < 500 and spans.distinct().count() < 500
