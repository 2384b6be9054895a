import pytest
from pyspark.sql import functions as F

from tamiz.functions import types as Y
from tamiz.operators import catalog as O

COLS = "table string, column string, type string, nullable boolean"


def rows(spark, data, ddl=COLS):
    return spark.createDataFrame(data, ddl)


def test_drift(spark):
    db = rows(spark, [("A", "X", "NUMBER(10)", True), ("a", "y", "VARCHAR2(10)", False), ("A", "W", "DATE", True), ("N", "Q", "DATE", True)])
    model = rows(spark, [("A", "X", "NUMBER(12)", True), ("A", "Y", "varchar2( 10 CHAR )", None), ("A", "Z", "DATE", True), ("G", "Q", "DATE", True)])
    got = {(r["table"], r["column"], r["change"]): (r["db_type"], r["model_type"], r["db_nullable"], r["model_nullable"])
           for r in O.schema_drift(db, model).collect()}
    assert got == {("A", "X", "modified"): ("NUMBER(10)", "NUMBER(12)", None, None), ("A", "Y", "modified"): (None, None, False, True),
                   ("A", "W", "column only in database"): (None,) * 4, ("A", "Z", "column only in model"): (None,) * 4,
                   ("N", None, "table only in database"): (None,) * 4, ("G", None, "table only in model"): (None,) * 4}
    assert O.schema_drift(db, db).count() == 0
    assert O.schema_drift(db, model, ["n"]).count() == 1
    labels = {r["label"] for r in O.drift_labels(db, model, rows(spark, [("N",)], "table string")).collect()}
    assert labels == {"TYPE_DIFF", "NULLABLE_DIFF", "NEW_COL", "REMOVED_COL", "ORPHAN_RECOVERED", "MISSING"}
    dev = {r["change"]: (r["count"], r["names"]) for r in O.model_deviation(O.schema_drift(db, model)).collect()}
    assert dev["modified"] == (2, ["A.X", "A.Y"])


def test_unloaded_side_is_refused(spark):
    db = rows(spark, [("A", "X", "DATE", True)])
    with pytest.raises(ValueError, match="side b"):
        O.compare_environments(db, db.limit(0))


def test_loose_numbers(spark):
    db, model = rows(spark, [("A", "X", "NUMBER", True)]), rows(spark, [("A", "X", "NUMBER(38)", True)])
    assert O.schema_drift(db, model).count() == 1 and O.drift_labels(db, model).count() == 0


def test_change_plan(spark):
    db = rows(spark, [("A", "X", "NUMBER(10)", True)])
    model = rows(spark, [("A", "X", "NUMBER(12)", False), ("A", "Y", "DATE", True), ("G", "Q", "DATE", True)])
    rel = rows(spark, [("G", "Q", "A", "X"), ("A", "Y", "G", "Q")], "source_table string, source_column string, target_table string, target_column string")
    idx = rows(spark, [("G", "IX", ["Q"], True)], "table string, name string, columns array<string>, unique boolean")
    got = {(r["operation"], r["table"], r["column"], r["from"], r["to"]) for r in O.change_plan(O.schema_drift(db, model), rel, idx).collect()}
    assert got == {("MODIFY_COLUMN", "A", "X", "NUMBER(10) null=true", "NUMBER(12) null=false"), ("ADD_COLUMN", "A", "Y", None, None),
                   ("CREATE_TABLE", "G", None, None, None), ("ADD_FK", "G", "Q", None, "A.X"), ("CREATE_INDEX", "G", None, None, "IX(Q)")}


@pytest.mark.parametrize("name,data,char,prec,scale,used,dialect,want", [
    ("VARCHAR2", 40, 10, None, None, "C", "ORACLE", "VARCHAR2(10 CHAR)"), ("VARCHAR2", 40, 10, None, None, "B", "ORACLE", "VARCHAR2(40 BYTE)"),
    ("RAW", 16, 0, None, None, None, "ORACLE", "RAW(16)"), ("RAW", None, 0, None, None, None, "ORACLE", "RAW"),
    ("NUMBER", 22, 0, None, None, None, "ORACLE", "NUMBER"), ("NUMBER", 22, 0, 12, 2, None, "ORACLE", "NUMBER(12,2)"),
    ("NUMBER", 22, 0, 12, 0, None, "ORACLE", "NUMBER(12)"), ("TIMESTAMP(6)", 11, 0, None, 6, None, "ORACLE", "TIMESTAMP(6)"),
    ("nvarchar", 20, None, None, None, None, "SQLSERVER", "nvarchar(10)"), ("varchar", -1, None, None, None, None, "SQLSERVER", "varchar(MAX)"),
    ("decimal", 9, None, 18, 2, None, "SQLSERVER", "decimal(18,2)"), ("datetime2", 8, None, None, 7, None, "SQLSERVER", "datetime2(7)"),
    ("char", 0, None, None, None, None, "SQLSERVER", "char")])
def test_rendered_types(spark, name, data, char, prec, scale, used, dialect, want):
    df = rows(spark, [(name, data, char, prec, scale, used)], "n string, d int, c int, p int, s int, u string")
    assert df.select(Y.render_type(*[F.col(c) for c in "ndcpsu"], dialect).alias("r")).first()["r"] == want


def test_type_lookup(one):
    to = lambda c: Y.map_type(c, "ORACLE", "SQLSERVER")
    assert [one(to, t) for t in ("NUMBER", "NUMBER(10,2)", "varchar2(5)", "CLOB", "XMLTYPE")] == [
        "DECIMAL(18,2)", "DECIMAL(10,2)", "VARCHAR(5)", "NVARCHAR(MAX)", "XMLTYPE"]
    assert one(lambda c: Y.map_type(c, "SQLSERVER", "ORACLE"), "BIT") == "NUMBER(1)"
    assert [one(lambda c: Y.missing_size(c, "ORACLE"), t) for t in ("RAW", "char", "CHAR(1)", "DATE")] == ["invalid", "silent", None, None]


def test_merging_keeps_human_fields(spark):
    ddl = COLS + ", pk_pos int, description string, pii boolean, safe boolean"
    old = rows(spark, [("A", "X", "NUMBER(5)", True, None, "clave", True, None), ("A", "GONE", "DATE", True, None, "d", None, None),
                       ("U", "Z", "DATE", True, 1, "no vista", None, True)], ddl)
    fresh = rows(spark, [("A", "X", "NUMBER(9)", False, 1, "", None, None), ("A", "NEW", "DATE", True, None, "", None, None)], ddl)
    got = {(r["table"], r["column"]): (r["type"], r["nullable"], r["pk_pos"], r["description"], r["pii"], r["safe"]) for r in O.merge_schema(old, fresh).collect()}
    assert got == {("A", "X"): ("NUMBER(9)", False, 1, "clave", True, None), ("A", "NEW"): ("DATE", True, None, "", None, None),
                   ("U", "Z"): ("DATE", True, 1, "no vista", None, True)}


def test_coverage_cases(spark):
    real = rows(spark, [("tablas", 329), ("secuencias", 18)], "section string, real bigint")
    cap = rows(spark, [("tablas", 323), ("secuencias", 17), ("vistas", 4)], "section string, captured bigint")
    exc = rows(spark, [("secuencias", 1, "interna")], "section string, excluded bigint, reason string")
    cov = O.coverage(real, cap, exc)
    assert {r["section"]: r["gap"] for r in cov.collect()} == {"tablas": 6, "secuencias": 0, "vistas": 0}
    assert O.coverage_note(cov, False).first()["partial"] and "grant" in O.coverage_note(cov, False).first()["note"]
    assert O.coverage_note(cov.where("gap = 0"), True).first()["note"] == ""


def test_key_order(spark):
    df = rows(spark, [("A", "X", 1, None, 2), ("A", "Y", 2, None, 1), ("B", "P", 1, True, None), ("B", "Q", 2, None, 2), ("C", "K", 1, True, None)],
              "table string, column string, ord int, pk_flag boolean, pk_pos int")
    assert {r["table"]: (r["pk"], r["ambiguous"]) for r in O.pk_order(df).collect()} == {
        "A": (["Y", "X"], False), "B": (["P", "Q"], True), "C": (["K"], False)}


def test_mined_relations(spark):
    sql = ["SELECT * FROM DEUDA d JOIN CLIENTE c ON d.idcli = c.id WHERE d.idexp = c.idexp ORDER BY 1",
           "select * from deuda where deuda.x = deuda.y", "SELECT * FROM DEUDA d WHERE d.IDPAIS IN (SELECT p.ID FROM PAIS p)"]
    got = {tuple(r)[:6] for r in O.infer_relations(spark.createDataFrame([(s,) for s in sql], "sql string")).collect()}
    assert got == {("DEUDA", "IDCLI", "CLIENTE", "ID", "JoinClause", "high"), ("DEUDA", "IDEXP", "CLIENTE", "IDEXP", "WhereClause", "medium"),
                   ("DEUDA", "IDPAIS", "PAIS", "ID", "InSubquery", "low")}


def test_exclusions(spark):
    tables = rows(spark, [("ALFA",), ("BETA_BAK",), ("GAMMA",)], "table string")
    got = {r["table"]: (r["excluded"], r["suspicious"], r["reason"]) for r in
           O.apply_exclusions(tables, rows(spark, [("alfa", None)], "name string, reason string")).collect()}
    assert got == {"ALFA": (True, False, "no reason given"), "BETA_BAK": (False, True, None), "GAMMA": (False, False, None)}
    fks = rows(spark, [("F1", "GAMMA", "ALFA"), ("F2", "ALFA", "X"), ("F3", "GAMMA", "BETA_BAK")], "name string, table string, ref_table string")
    kept = tables.where("table <> 'ALFA'")
    assert [r["name"] for r in O.dangling_foreign_keys(fks, kept).collect()] == ["F1"]


def test_assembled_dictionary(spark):
    cols = rows(spark, [("A", "Y", 2, "DATE"), ("A", "X", 1, "NUMBER")], "table string, column string, ord int, type string")
    cons = rows(spark, [("P", "A", "PK", "Y", 2, None, None, None), ("P", "A", "PK", "X", 1, None, None, None), ("R", "A", "FK", "X", 1, "B", "BX", "CASCADE")],
                "kind string, table string, name string, column string, pos int, ref_table string, ref_column string, delete_rule string")
    checks = rows(spark, [("A", "C1", '"X" IS NOT NULL'), ("A", "C2", "X > 0")], "table string, name string, condition string")
    idx = rows(spark, [("A", "I", True, "Y", 2, "DESC"), ("A", "I", True, "X", 1, "ASC")],
               "table string, name string, unique boolean, column string, pos int, direction string")
    r = O.assemble_tables(cols, cons, checks, idx).first()
    assert [c["column"] for c in r["columns"]] == ["X", "Y"] and r["pk"] == ["X", "Y"] and [c["name"] for c in r["checks"]] == ["C2"]
    assert [(c["column"], c["direction"]) for c in r["indexes"][0]["cols"]] == [("X", "ASC"), ("Y", "DESC")]
    assert O.foreign_keys(cons).first()["pairs"][0]["ref_column"] == "BX"


def test_lookups(spark):
    cols = rows(spark, [("A", "X", "DATE"), ("B", "Y", "DATE")], "table string, column string, type string")
    found, missing = O.table_schema(cols, rows(spark, [("a",), ("z",)], "table string"))
    assert found.first()["column"] == "X" and missing.first()["table"] == "Z"
    kept, status = O.refresh_subset(cols, cols.withColumn("type", F.lit("CLOB")), rows(spark, [("b",), ("q",)], "table string"))
    assert {(r["table"], r["type"]) for r in kept.collect()} == {("A", "DATE"), ("B", "CLOB")}
    assert {r["table"]: r["status"] for r in status.collect()} == {"B": "updated", "Q": "not_in_db"}
    found = O.table_inventory({"a": cols, "b": cols.limit(0), "c": None, "d": cols}, {"d": ("type", "none")})
    assert {(r["table"], r["status"]) for r in found.collect()} == {("a", "data"), ("b", "empty"), ("c", "unreadable"), ("d", "data")}
    assert found.where("table = 'd'").agg({"objects": "sum"}).first()[0] == found.where("table = 'a'").first()["objects"] == cols.count()
    assert {r["status"] for r in O.table_inventory({"c": None}).collect()} == {"unreadable"}
