import json

import pytest
from pyspark.sql import functions as F

from tamiz.operators import logs
from tamiz.operators import stats as T
from tamiz.operators.validate import Field, Structure
from tamiz.sources import documents as D
from tamiz.sources import sinks as Z
from tamiz.sources import text as A


def test_lines_and_encodings(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.log").write_bytes("\ufeffuno\r\n\ufeffdos é\n\ncuatro".encode())
    (tmp_path / "sub" / "b.log").write_bytes("línea € “x”\nfin\n".encode("cp1252"))
    (tmp_path / "c.txt").write_text("no")
    rows = A.read_lines(spark, str(tmp_path), "*.log").collect()
    got = {(r["file"].rsplit("/", 1)[1], r["line_no"], r["text"]) for r in rows}
    assert got == {("a.log", 1, "uno"), ("a.log", 2, "\ufeffdos é"), ("a.log", 3, ""), ("a.log", 4, "cuatro"),
                   ("b.log", 1, "línea € “x”"), ("b.log", 2, "fin")}


def test_large_files_are_numbered_across_blocks(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"linea {i}\n" for i in range(1, 20001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = A.read_lines(spark, str(tmp_path))
        assert lines.count() == 20000
        assert lines.where(F.concat(F.lit("linea "), F.col("line_no").cast("string")) != F.col("text")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_client_output(spark, tmp_path):
    (tmp_path / "r.txt").write_text("A | B\n--- | ---\n 1 | dos \n\n 2 |\n")
    rows = A.read_result_text(spark, str(tmp_path / "r.txt")).collect()
    assert [(r["A"], r["B"] or "") for r in rows] == [("1", "dos"), ("2", "")]
    (tmp_path / "q.txt").write_text('A,B\n"x,1","-"\n')
    assert A.read_result_text(spark, str(tmp_path / "q.txt"), ",", quoted=True).first()["A"] == "x,1"


def test_error_xml(spark, tmp_path):
    detail = "&#10;".join(f"l{i}" for i in range(30))
    (tmp_path / "e.xml").write_text(f'<errors><error time="2026-08-11 10:00:00" type="System.IO.IOException" message="no abre" detail="{detail}"/>'
                                    '<error time="" type="T" message="m"/></errors>')
    rows = D.read_error_xml(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and len(rows[0]["lines"]) == 21 and rows[1]["lines"] == ["T: m"]
    d = logs.describe_events(D.read_error_xml(spark, str(tmp_path))).collect()
    assert d[0]["exception"] == "System.IO.IOException" and d[1]["exception"] == "SinExcepcion"


def test_results_roll_up(spark, tmp_path):
    trx = ('<TestRun><Results><UnitTestResult testName="a" outcome="Failed"><Output><ErrorInfo><Message>x\n y</Message><StackTrace>s</StackTrace>'
           '</ErrorInfo></Output></UnitTestResult><UnitTestResult testName="b" outcome="Passed"/></Results><ResultSummary>'
           '<Counters total="{t}" executed="{e}" passed="1" failed="1" error="1" timeout="0" aborted="0" notExecuted="0" inconclusive="0"/></ResultSummary></TestRun>')
    (tmp_path / "1.trx").write_text(trx.format(t=5, e=3))
    (tmp_path / "2.trx").write_text(trx.format(t=2, e=2))
    (tmp_path / "3.trx").write_text(trx.format(t=9, e=9)[:60])
    counters, results = D.read_test_results(spark, str(tmp_path))
    r = T.test_rollup(counters).first()
    assert (r["total"], r["passed"], r["failed"], r["skipped"], r["files"]) == (7, 2, 4, 2, 2)
    assert {f["message"] for f in T.failures(results).collect()} == {"x y"}
    assert T.test_rollup(counters.limit(0)).first()["total"] is None


@pytest.mark.parametrize("as_list", [False, True])
def test_catalog_shapes(spark, tmp_path, as_list):
    cols = {"id": {"type": "NUMBER(10)", "pk": 1}, "nombre": {"type": "VARCHAR2(9)", "pii": True, "pk": True}, "x": {"type": "DATE", "nullable": False}}
    tables = {"deuda": {"columns": cols}}
    if as_list:
        tables = [{"name": "deuda", "columns": [{"name": n, **c} for n, c in cols.items()]}]
    (tmp_path / "m.json").write_text("﻿" + json.dumps({"tables": tables}))
    got = {r["column"]: (r["table"], r["type"], r["pk_flag"], r["pk_pos"], r["pii"], r["safe"], r["nullable"])
           for r in D.read_catalog(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"ID": ("DEUDA", "NUMBER(10)", None, 1, None, None, None), "NOMBRE": ("DEUDA", "VARCHAR2(9)", True, None, True, None, None),
                   "X": ("DEUDA", "DATE", None, None, None, None, False)}


def test_catalog_root_must_be_an_object(spark, tmp_path):
    (tmp_path / "m.json").write_text("[1]")
    with pytest.raises(Exception, match="object"):
        D.read_catalog(spark, str(tmp_path / "m.json")).collect()


def test_history_file(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps([{"id": "1", "timestamp": "2026-01-01T00:00:00", "status": "success", "agents": ["a"]}]))
    (tmp_path / "bad.json").write_text("[{ no")
    assert D.read_history(spark, str(tmp_path / "h.json")).first()["agents"] == ["a"]
    assert D.read_history(spark, str(tmp_path / "bad.json")).count() == 0
    assert D.read_history(spark, str(tmp_path / "none.json")).count() == 0


def test_dictionary_of_the_session(spark):
    spark.range(3).selectExpr("id", "cast(id as string) as n").createOrReplaceTempView("dic_view")
    got = {(r["column"], r["type"], r["ord"]) for r in D.read_dictionary(spark).where("table = 'DIC_VIEW'").collect()}
    assert got == {("ID", "BIGINT", 1), ("N", "STRING", 2)}


def test_commit_log_and_diff(spark):
    sep = "\u001f"
    text = ["A\tantes.txt", sep.join(["r2", "ana", "2026-01-02", "Corrige #12"]), "M\ta.cs", "R100\tviejo.cs\tnuevo.cs",
            sep.join(["r1", "luis", "2026-01-01", "Alta"]), "D\ta.cs"]
    lines = spark.createDataFrame([("l", i, t) for i, t in enumerate(text, 1)], "file string, line_no bigint, text string")
    commits, files = A.parse_commit_log(lines, chunk=2)
    assert {(r["revision"], r["message"]) for r in commits.collect()} == {("r2", "Corrige #12"), ("r1", "Alta")}
    assert {(r["revision"], r["action"], r["path"]) for r in files.collect()} == {
        (None, "A", "antes.txt"), ("r2", "M", "a.cs"), ("r2", "R", "nuevo.cs"), ("r1", "D", "a.cs")}
    diff = ["ruido", "diff --git a/x.cs b/x.cs", "--- a/x.cs", "+++ b/x.cs", "+public void A() {", "-b", " c"]
    rows = A.parse_diff(spark.createDataFrame([("d", i, t) for i, t in enumerate(diff, 1)], "file string, line_no bigint, text string"), chunk=2)
    assert [(r["file"], r["sign"]) for r in rows.orderBy("line_no").collect()] == [("x.cs", s) for s in (" ", " ", "+", "-", " ")]


def test_structured_forms(spark, tmp_path):
    fields = (Field("a"), Field("b"))
    (tmp_path / "f.csv").write_text('A;B\n1;"x;""y"\n2;z\n')
    plain = A.read_structured_file(spark, str(tmp_path / "f.csv"), Structure("S", fields=fields, tiene_cabecera=True))
    assert {(r["a"], r["b"]) for r in plain.collect()} == {("1", '"x'), ("2", "z")}
    quoted = A.read_structured_file(spark, str(tmp_path / "f.csv"), Structure("S", fields=fields, text_qualifier='"', tiene_cabecera=True))
    assert {(r["line_no"], r["a"], r["b"]) for r in quoted.collect()} == {(2, "1", 'x;"y'), (3, "2", "z")}


def test_terminated_rows(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1|@#@|a\nb@@LF@@c@@ROWEND@@\r\n2|@#@|@@NULL@@@@ROWEND@@\n3|@#@|@@ROWEND@@\n4@@ROWEND@@\n")
    rows, bad = A.read_terminated_rows(spark, str(tmp_path / "t.txt"), ["id", "t"])
    assert {(r["id"], r["t"]) for r in rows.collect()} == {("1", "a\nb\nc"), ("2", None), ("3", "")}
    assert bad.first()["text"] == "4"


def test_insert_text(spark, tmp_path):
    df = spark.sql("SELECT 2 AS id, \"O'Neil\" AS t, DATE'2026-01-02' AS f, X'0AFF' AS b, X'00' AS doc, 1.50D AS n UNION ALL "
                   "SELECT 1, '', NULL, NULL, NULL, 100D")
    rows = [r["statement"] for r in Z.insert_statements(df, "T", large=("doc",)).collect()]
    assert rows[0] == "INSERT INTO T (id, t, f, b, doc, n) VALUES (2, 'O''Neil', '2026-01-02 00:00:00', HEXTORAW('0AFF'), NULL, 1.5);"
    assert rows[1] == "INSERT INTO T (id, t, f, b, doc, n) VALUES (1, '', NULL, NULL, NULL, 100);"
    assert "0x0AFF" in Z.insert_statements(df, "T", "SQLSERVER").first()["statement"]
    Z.to_insert_sql(df, "T", str(tmp_path / "o"), ["id"], large=("doc",))
    parts = sorted((tmp_path / "o").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[0] == "-- Inserts T" and lines[1].endswith("doc") and lines[-1] == "commit;" and "VALUES (1," in lines[-3] and "VALUES (2," in lines[-2]


def test_export_goes_on_after_a_failure(spark, tmp_path):
    good = spark.range(2).selectExpr("id")
    bad = good.select(F.raise_error(F.lit("x")).cast("bigint").alias("id"))
    got = {s[0]: s[1:3] for s in Z.export_tables({"A": (good, ["id"]), "B": (bad, ["id"])}, str(tmp_path))}
    assert got == {"A": ("OK", 2), "B": ("ERROR", 0)}
    assert Z.pick_tables(["a", "b", "a"], ["c", "d"], ["b"], {"A": False, "C": True}) == (["A"], [("C", "orphan"), ("D", "not in the catalog")])


def test_history_rotation(spark, tmp_path):
    rows = [(f"{i:03d}", f"2026-0{1 + i // 100}-01T00:00:{i % 60:02d}", f"deudor 12345678Z {i}") for i in range(250)]
    df = spark.createDataFrame(rows, "id string, timestamp string, task string")
    kept, old = Z.split_history(df, 100)
    assert kept.count() == 100 and old.count() == 150 and set(r["month"] for r in old.select("month").distinct().collect()) <= {"202601", "202602", "202603"}
    assert kept.where("task LIKE '%12345678Z%'").count() == 0
    assert kept.agg(F.min("timestamp")).first()[0] >= old.agg(F.max("timestamp")).first()[0]
    assert Z.split_history(df.limit(5), 100)[1].count() == 0
    now, past = str(tmp_path / "now"), str(tmp_path / "old")
    Z.append_history(df, now, past, 100)
    assert spark.read.json(past).count() == 150
    # Read from, add to and write to the same folder, again and again.
    for n in (1, 2, 3):
        back = D.read_history(spark, now)
        assert back.count() == 100
        new = spark.createDataFrame([(f"n{n}", f"2026-09-0{n}T00:00:00", "x")], "id string, timestamp string, task string")
        Z.append_history(back.unionByName(new, allowMissingColumns=True), now, past, 100)
    assert D.read_history(spark, now).where("id LIKE 'n%'").count() == 3 and spark.read.json(past).select("id").distinct().count() == spark.read.json(past).count() == 153


def test_history_texts(spark):
    texts = spark.createDataFrame([('\ufeff[{"id": "1", "task": "a",\n "agents": ["x"]}, {"task": "no id"}]',), ('{"id": "2"}\n\nbroken\n{"id": "3"}\n',), ("[broken",), ("",), (None,)], "value string")
    assert sorted(r["id"] for r in D.parse_history(texts).collect()) == ["1", "2", "3"]


def test_numbers_and_times_of_insert_scripts(spark):
    df = spark.sql("SELECT CAST(v AS DOUBLE) AS v, TIMESTAMP_NTZ'2026-01-02 03:04:05.123456' AS t FROM VALUES ('1.123456789012345'), ('1e-12'), ('NaN'), ('-Infinity'), ('100') AS x(v)")
    texts = {d: [r[0].split("VALUES (")[1] for r in Z.insert_statements(df, "T", d).collect()] for d in ("ORACLE", "SQLSERVER")}
    assert [t.split(",")[0] for t in texts["ORACLE"]] == ["1.123456789012345", "0.000000000001", "BINARY_DOUBLE_NAN", "-BINARY_DOUBLE_INFINITY", "100"]
    assert [t.split(",")[0] for t in texts["SQLSERVER"]][2:] == ["NULL", "NULL", "100"]
    assert "'2026-01-02 03:04:05');" in texts["ORACLE"][0] and "'2026-01-02 03:04:05.123456');" in texts["SQLSERVER"][0]


def test_partition_replacement(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string").write.partitionBy("k").parquet(path)
    Z.replace_partition(spark.createDataFrame([(3, "a")], "v int, k string"), path, "k")
    assert {(r["v"], r["k"]) for r in spark.read.parquet(path).collect()} == {(3, "a"), (2, "b")}
