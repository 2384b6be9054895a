"""Masking by origin: whatever a column is called, what it is made of decides."""

import pytest

from tamiz.operators import guard
from tamiz.operators import personal as O
from tamiz.operators.lineage import lineage

KEY = b"a fixed key of the tests"
POLICY = O.Policy.build("enforce")
SCHEMA = "table string, column string, type string, nullable boolean, pk_flag boolean, pk_pos int, fk boolean, pii boolean, safe boolean"


@pytest.fixture(scope="module")
def tables(spark):
    spark.createDataFrame([(1, 1900, 7, "n1"), (2, 2100, 8, "n2"), (3, 2100, 9, "n3")], "id long, salary long, dept long, notes string").createOrReplaceTempView("emp")
    spark.createDataFrame([(7, 100), (8, 200)], "dept long, budget long").createOrReplaceTempView("dep")
    spark.sql("CREATE OR REPLACE TEMP VIEW pay AS SELECT id AS who, salary AS amount FROM emp")
    rows = [("EMP", "ID", "NUMBER(10)", True, True, 1, None, None, None), ("EMP", "SALARY", "NUMBER(10)", True, None, None, None, True, None),
            ("EMP", "DEPT", "NUMBER(10)", True, None, None, True, None, None), ("EMP", "NOTES", "VARCHAR2(20)", True, None, None, None, None, None),
            ("DEP", "DEPT", "NUMBER(10)", True, True, 1, None, None, None), ("DEP", "BUDGET", "NUMBER(10)", True, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


HIDDEN = [
    "SELECT salary AS x FROM emp", "SELECT x.salary k FROM emp x", "WITH w AS (SELECT salary AS s FROM emp) SELECT s FROM w", "SELECT s FROM (SELECT salary s FROM emp) q",
    "SELECT sum(salary) AS total FROM emp", "SELECT salary + 0 AS dept FROM emp", "SELECT dept FROM (SELECT salary AS dept FROM emp)",
    "SELECT dept FROM dep UNION ALL SELECT salary FROM emp", "SELECT salary AS b FROM emp INTERSECT SELECT salary FROM emp", "SELECT b FROM (SELECT budget AS b FROM dep EXCEPT SELECT salary FROM emp)",
    "SELECT CASE WHEN salary > 2000 THEN 1 ELSE 0 END AS id FROM emp", "SELECT max(struct(salary, id)).salary AS id FROM emp",
    "SELECT e AS id FROM emp LATERAL VIEW explode(array(salary, 1)) t AS e", "SELECT amount AS id FROM pay", "SELECT sum(salary) OVER (PARTITION BY dept) AS id FROM emp",
    "SELECT (SELECT max(salary) FROM emp) AS id FROM dep", "SELECT v AS id FROM emp UNPIVOT (v FOR n IN (salary, id))",
    "SELECT id FROM (SELECT * FROM (SELECT dept, salary FROM emp) PIVOT (max(salary) AS m FOR dept IN (7 AS id)))",
    "WITH RECURSIVE r(n, v) AS (SELECT 1, salary FROM emp UNION ALL SELECT n + 1, v FROM r WHERE n < 2) SELECT v AS id FROM r",
    "SELECT l.v AS id FROM dep d, LATERAL (SELECT e.salary AS v FROM emp e WHERE e.dept = d.dept) l", "SELECT named_struct('a', salary).a AS id FROM emp",
    "SELECT count(salary) + max(salary) AS id FROM emp", "SELECT list[0] AS id FROM (SELECT collect_list(salary) AS list FROM emp)",
    "SELECT id IN (SELECT salary FROM emp) AS flag FROM emp", "SELECT coalesce(salary, id) AS id FROM emp"]


@pytest.mark.parametrize("sql", HIDDEN)
def test_no_name_hides_an_origin(spark, tables, sql):
    df, report = guard.guarded_query(spark, sql, tables, POLICY, KEY)
    assert report.masked == df.columns and not report.error
    assert all(str(r[0]).startswith("pii:") for r in df.collect())


@pytest.mark.parametrize("sql,rows", [
    ("SELECT count(salary) AS n, count(DISTINCT salary) AS kinds FROM emp", [(3, 2)]), ("SELECT dept AS d, count(*) AS n FROM emp WHERE salary > 2000 GROUP BY dept", [(8, 1), (9, 1)]),
    ("SELECT id AS k FROM emp ORDER BY salary, id", [(1,), (2,), (3,)]), ("SELECT d.budget AS b FROM dep d JOIN emp e ON d.dept = e.dept AND e.salary > 0", [(100,), (200,)]),
    ("SELECT approx_count_distinct(salary) AS n FROM emp", [(2,)]), ("SELECT budget FROM dep WHERE EXISTS (SELECT 1 FROM emp WHERE salary > 1)", [(100,), (200,)])])
def test_counts_and_filters_leave_other_columns_clear(spark, tables, sql, rows):
    df, report = guard.guarded_query(spark, sql, tables, POLICY, KEY)
    assert report.masked == [] and sorted(map(tuple, df.collect())) == rows


def test_report_names_the_tables_that_are_read(spark, tables):
    _, report = guard.guarded_query(spark, "WITH w AS (SELECT * FROM emp) SELECT w.id FROM w JOIN range(3) r ON r.id = w.id, dep", tables, POLICY, KEY)
    assert sorted(report.tables) == ["DEP", "EMP"]


@pytest.mark.parametrize("sql", ["SELECT value FROM emp, text.`{0}`", "SELECT value FROM emp e, LATERAL (SELECT * FROM text.`{0}`)", "SELECT value FROM emp CROSS JOIN text.`{0}`",
                                 "SELECT (SELECT max(value) FROM text.`{0}`) AS v", "WITH w AS (SELECT value FROM `text`.`{0}`) SELECT * FROM w", "SELECT value FROM emp /* , */ , /* x */ text /* y */ . `{0}`",
                                 "SELECT id FROM emp WHERE id IN (SELECT length(value) FROM text.`{0}`)", "SELECT value FROM emp JOIN dep USING (dept), (text.`{0}`)"])
def test_files_past_the_catalog_are_refused(spark, tables, tmp_path, sql):
    (tmp_path / "nums.txt").write_text("12345\n")
    statement = sql.format(tmp_path / "nums.txt")
    with pytest.raises(guard.RefusedQuery):
        guard.guarded_query(spark, statement, tables, POLICY, KEY)
    assert lineage(spark.sql(statement)).files


def test_tables_of_the_catalog_are_no_loose_files(spark, tables, tmp_path):
    spark.range(3).write.mode("overwrite").saveAsTable("numbers_kept")
    found = lineage(spark.sql("SELECT n.id + e.id AS s FROM numbers_kept n, emp e"))
    assert found.files == [] and set(found.tables) == {"NUMBERS_KEPT", "EMP"} and found.origins == [{("NUMBERS_KEPT", "ID"), ("EMP", "ID")}]
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "p"))
    spark.read.parquet(str(tmp_path / "p")).createOrReplaceTempView("viewed")
    assert lineage(spark.sql("SELECT id FROM viewed")).files == []
    spark.sql("DROP TABLE numbers_kept")


def test_comma_lists_in_the_text_gate(one):
    from tamiz.functions import sqltext as S
    assert one(S.readonly_reason, "SELECT * FROM a, parquet.`/x`") == S.READS_PATH
    assert one(S.readonly_reason, "SELECT csv.`my col` FROM csv WHERE b IN (1, 2) ORDER BY a, csv.`my col`") is None
