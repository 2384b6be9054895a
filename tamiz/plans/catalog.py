"""Registered queries: catalog, drift and coverage. The parts stand for declared columns, so the
catalog grows with the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.functions import types as Y
from tamiz.operators import catalog as O
from tamiz.operators import sourcetext as T
from tamiz.plans.base import TABLES
from tamiz.plans.personal import statements
from tamiz.session import local_rows, table

# Column definitions both SQL dialects read the same way.
TYPE = """CASE p_type WHEN 'SMALL' THEN 'VARCHAR2(' || CAST(p_size AS TXT) || ' CHAR)' WHEN 'MEDIUM' THEN 'NUMBER(' || CAST(p_size AS TXT) || ',2)'
  WHEN 'STANDARD' THEN 'NUMBER' WHEN 'ECONOMY' THEN 'DATE' WHEN 'LARGE' THEN 'CHAR' ELSE 'raw' END"""
# A table holds a hundred parts at most, as a declared table has a bounded number of columns.
TABLE = "upper(replace(p_name, ' ', '_')) || '_' || CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS TXT)"
COLUMN = "'C' || CAST(p_partkey AS TXT)"
MODEL_TABLE = f"CASE WHEN p_name LIKE 'hot%' THEN {TABLE} || '_NEW' ELSE {TABLE} END"
MODEL_COLUMN = f"CASE WHEN p_size = 7 THEN 'M' || CAST(p_partkey AS TXT) ELSE {COLUMN} END"
MODEL_TYPE = f"""CASE WHEN p_size = 11 THEN '' WHEN p_size = 12 THEN 'CLOB' WHEN p_type = 'STANDARD' THEN 'NUMBER(38)'
  WHEN p_type = 'SMALL' THEN 'varchar2( ' || CAST(p_size AS TXT) || ' )' ELSE {TYPE} END"""


def _expr(sql):
    return F.expr(sql.replace("TXT", "STRING"))


def _as_text(df, *columns):
    """Nullable flags and numbers as text, so that NULLs compare alike everywhere."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def database(spark, folder):
    return table(spark, folder, "part").select(
        _expr(TABLE).alias("table"), _expr(COLUMN).alias("column"), _expr(TYPE).alias("type"), (F.col("p_size") > 5).alias("nullable"))


def model(spark, folder):
    return table(spark, folder, "part").select(
        _expr(MODEL_TABLE).alias("table"), _expr(MODEL_COLUMN).alias("column"), _expr(MODEL_TYPE).alias("type"),
        F.when(F.col("p_size") == 3, None).otherwise(F.col("p_size") > 6).alias("nullable"))


def schema_drift(spark, folder):
    out = O.schema_drift(database(spark, folder), model(spark, folder))
    return _as_text(out, "db_nullable", "model_nullable")


def drift_labels(spark, folder):
    orphans = table(spark, folder, "part").where("p_brand = 'Brand#1'").select(_expr(TABLE).alias("table"))
    return O.drift_labels(database(spark, folder), model(spark, folder), orphans)


def env_compare(spark, folder):
    out = O.compare_environments(database(spark, folder), model(spark, folder))
    return out.groupBy("table", "change").agg(F.count("*").alias("differences"))


def _indexes(spark, folder, by):
    return table(spark, folder, "part").select(
        _expr(MODEL_TABLE).alias("table"), F.concat(F.lit("IX"), F.col("p_partkey").cast("string")).alias("name"),
        F.array(F.col("p_brand"), F.when(F.col("p_size") == 9, F.lit(by)).otherwise(F.col("p_type"))).alias("columns"),
        (F.col("p_size") > 20).alias("unique"), F.when(F.col("p_size") > 40, "manual").otherwise("db").alias("source"))


def compare_indexes(spark, folder):
    a = _indexes(spark, folder, "X").where("columns[1] <> 'PROMO'")
    return O.compare_indexes(a, _indexes(spark, folder, "Y").where("columns[1] <> 'LARGE'"))


def change_plan(spark, folder):
    relations = table(spark, folder, "part").where("p_size = 20").select(
        _expr(MODEL_TABLE).alias("source_table"), _expr(MODEL_COLUMN).alias("source_column"),
        F.lit("parts").alias("target_table"), F.col("p_brand").alias("target_column"))
    drift = O.schema_drift(database(spark, folder), model(spark, folder))
    return O.change_plan(drift, relations, _indexes(spark, folder, "X"))


def model_deviation(spark, folder):
    out = O.model_deviation(schema_drift(spark, folder))
    return out.withColumn("names", F.array_join("names", ","))


def type_map(spark, folder):
    types = database(spark, folder).select("table", "column", "type")
    return types.select("table", "column", Y.map_type(F.col("type"), "ORACLE", "SQLSERVER").alias("sqlserver"),
                        Y.map_type(F.lit("BIGINT"), "SQLSERVER", "ORACLE").alias("key_type"),
                        Y.normalise_type(F.col("type")).alias("normal"))


def missing_size(spark, folder):
    types = database(spark, folder).select("table", "column", "type")
    return types.select("table", "column", Y.missing_size(F.col("type"), "ORACLE").alias("problem")).where("problem IS NOT NULL")


def render_type(spark, folder):
    part = table(spark, folder, "part")
    size, kind = F.col("p_size"), F.col("p_type")
    name = F.when(kind == "SMALL", "varchar2").when(kind == "MEDIUM", "NUMBER").when(kind == "LARGE", "RAW").otherwise("DATE")
    return part.select("p_partkey", Y.render_type(
        name, F.when(size > 10, size), size, F.when(size != 20, size), size % 3,
        F.when(size % 2 == 0, "C").otherwise("B"), "ORACLE").alias("rendered"),
        Y.build_type(name, size, size, size % 3).alias("built"))


def _sections(spark, folder):
    part = table(spark, folder, "part")
    section = F.col("p_brand").alias("section")
    real = part.where("p_brand <> 'Brand#2'").groupBy(section).agg(F.count("*").alias("real"))
    captured = part.where("p_size > 10").groupBy(section).agg(F.count("*").alias("captured"))
    excluded = part.where("p_size < 9").groupBy(section).agg(F.count("*").alias("excluded"), F.lit("small").alias("reason"))
    return real, captured, excluded


def coverage(spark, folder):
    return _as_text(O.coverage(*_sections(spark, folder)), "real")


def merge_coverage(spark, folder):
    real, captured, excluded = _sections(spark, folder)
    new = O.coverage(real, captured, excluded).where("section <> 'Brand#3'")
    old = (O.coverage(real, captured.withColumn("captured", F.lit(0).cast("bigint")), excluded)
           .withColumn("origin", F.lit("tables")).withColumn("date", F.lit("2026-01-01")))
    return _as_text(O.merge_coverage(old, new, "objects", "2026-02-01"), "real")


def _old(spark, folder):
    part = table(spark, folder, "part").where("p_size <> 30")
    return part.select(_expr(MODEL_TABLE).alias("table"), _expr(COLUMN).alias("column"), _expr(MODEL_TYPE).alias("type"),
                       F.lit(True).alias("nullable"), F.lit(None).cast("int").alias("pk_pos"), F.col("p_name").alias("description"),
                       F.when(F.col("p_size") == 1, True).alias("pii"), F.when(F.col("p_size") == 2, True).alias("safe"))


def _fresh(spark, folder):
    part = table(spark, folder, "part").where("p_size <> 31")
    return part.select(_expr(TABLE).alias("table"), _expr(COLUMN).alias("column"), _expr(TYPE).alias("type"),
                       (F.col("p_size") > 5).alias("nullable"), F.when(F.col("p_size") == 50, 1).alias("pk_pos"),
                       F.lit("").alias("description"), F.lit(None).cast("boolean").alias("pii"), F.lit(None).cast("boolean").alias("safe"))


def merge_schema(spark, folder):
    return _as_text(O.merge_schema(_old(spark, folder), _fresh(spark, folder)), "pk_pos", "pii", "safe", "nullable")


def refresh_subset(spark, folder):
    names = table(spark, folder, "part").where("p_name LIKE 'red%'").select(_expr(TABLE).alias("table")).unionByName(
        table(spark, folder, "nation").select(F.col("n_name").alias("table")))
    out, status = O.refresh_subset(_old(spark, folder), _fresh(spark, folder), names)
    a = out.groupBy("table").agg(F.count("*").alias("columns"), F.count_if(F.col("description") != "").alias("described"))
    return _as_text(status.join(a, "table", "full_outer"), "columns", "described")


def mark_visibility(spark, folder):
    tables = table(spark, folder, "part").select(_expr(MODEL_TABLE).alias("table")).distinct().withColumn("visible", F.lit(None).cast("boolean"))
    return _as_text(O.mark_visibility(tables, database(spark, folder), "2026-03-01"), "visible")


def merge_indexes(spark, folder):
    old, db = _indexes(spark, folder, "X"), _indexes(spark, folder, "Y").where("table LIKE 'RED%'")
    return O.merge_indexes(old, db).withColumn("columns", F.array_join("columns", ","))


def merge_relations(spark, folder):
    old = table(spark, folder, "lineitem").where("l_quantity > 5")
    new = table(spark, folder, "lineitem").where("l_quantity <= 5 AND l_linestatus <> 'F'")
    shape = lambda d: d.select(
        F.col("l_partkey").alias("source_table"), F.col("l_linenumber").alias("source_column"),
        F.col("l_suppkey").alias("target_table"), F.col("l_returnflag").alias("target_column"),
        F.when(F.col("l_linestatus") == "F", "manual").otherwise("log").alias("source"),
        F.struct("l_orderkey", "l_extendedprice").alias("seq"))
    return O.merge_relations(shape(old), shape(new)).select(
        *O.RELATION_KEY, "source", F.col("seq.l_orderkey").alias("row_key"))


def apply_exclusions(spark, folder):
    suffix = F.when(F.col("p_type") == "PROMO", "_BAK").when(F.col("p_type") == "SMALL", "_20260731").otherwise("")
    tables = table(spark, folder, "part").select(F.concat(F.lit("T"), F.col("p_partkey").cast("string"), suffix).alias("table"))
    rules = table(spark, folder, "part").where("p_size = 1").select(
        F.concat(F.lit("t"), F.col("p_partkey").cast("string"), suffix).alias("name"), F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("reason"))
    return O.apply_exclusions(tables, rules)


def dangling_keys(spark, folder):
    fks = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("name"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("table"),
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ref_table"))
    kept = table(spark, folder, "part").where("p_size > 3").select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("table"))
    return O.dangling_foreign_keys(fks, kept).groupBy("table", "ref_table").agg(F.count("*").alias("keys"))


def infer_relations(spark, folder):
    return O.infer_relations(statements(spark, folder))


# Program text of an order, by its priority: a verbatim literal over lines, a builder, an escaped quote, a comment and literals that
# close and open in one line. A file holds the orders of one customer.
CODE = [("1-URGENT", """var q = @"SELECT ""o"".X FROM ORDERS o\n  JOIN CUSTOMER c ON c.C_CUSTKEY = o.O_CUSTKEY\n  WHERE o.O_ORDERKEY = <key>"; // "FROM"""),
        ("2-HIGH", """var sb = new StringBuilder();\nsb.Append("SELECT <key> FROM LINEITEM l").AppendLine(\n  "JOIN PART p ON l.L_PARTKEY = p.P_PARTKEY");"""),
        ("3-MEDIUM", """Run("UPDATE ORDERS SET X = \\"a\\" WHERE K = <key>"); char c = '"';"""),
        ("4-NOT SPECIFIED", """// @"SELECT * FROM GHOST\nRun(@"DELETE FROM EVENTS WHERE K = <key>"); Log("none");"""),
        ("5-LOW", """Run(@"SELECT <key> FROM REGION\n  ", @"SELECT <key> FROM NATION\n");""")]


def source_lines(spark, folder):
    text = F.lit(None).cast("string")
    for priority, code in CODE:
        text = F.when(F.col("o_orderpriority") == priority, F.lit(code)).otherwise(text)
    text = F.replace(text, F.lit("<key>"), F.col("o_orderkey").cast("string"))
    return table(spark, folder, "orders").where("o_custkey IS NOT NULL").select(
        F.concat(F.lit("F"), F.col("o_custkey").cast("string"), F.lit(".cs")).alias("file"), F.col("o_orderkey").alias("k"),
        F.posexplode(F.split(text, "\n")).alias("pos", "text")).select("file", (F.col("k") * 10 + F.col("pos")).alias("line_no"), "text")


def source_statements(spark, folder):
    return T.source_statements(source_lines(spark, folder))


def source_relations(spark, folder):
    return O.infer_relations(T.source_statements(source_lines(spark, folder)))


def source_tables(spark, folder):
    return T.named_tables(T.source_statements(source_lines(spark, folder)))


def access_advice(spark, folder):
    layout = local_rows(spark, [("ORDERS", ["O_CUSTKEY", "O_ORDERKEY"]), ("CUSTOMER", ["C_CUSTKEY"])], "table string, columns array<string>")
    sizes = None
    for name in ("orders", "customer"):
        df = table(spark, folder, name)
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name.upper()).alias("table"), "rows", F.lit(len(df.columns) * 2).alias("n_columns"))
        sizes = one if sizes is None else sizes.unionByName(one)
    asked = statements(spark, folder).select(F.col("o_orderkey").alias("id"), "sql")
    return O.access_advice(asked, layout, sizes, large=100)


def truncation_risk(spark, folder):
    docs = O.truncation_risk(table(spark, folder, "documents"), {"text": (4000, False), "lang": (2, False), "source": (5, True)})
    return docs.unionByName(O.truncation_risk(table(spark, folder, "part"), {"p_name": (12, False), "p_type": (8, True)})).unionByName(
        O.truncation_risk(table(spark, folder, "orders"), {"o_totalprice": (7, False, 2), "o_custkey": (9, False, 0)}))


def pk_order(spark, folder):
    cols = table(spark, folder, "part").select(
        _expr(TABLE).alias("table"), _expr(COLUMN).alias("column"), F.col("p_partkey").alias("ord"),
        F.when(F.col("p_brand") == "Brand#4", True).alias("pk_flag"),
        F.when(F.col("p_brand") == "Brand#5", F.col("p_partkey") * -1 + 100000000).cast("int").alias("pk_pos"))
    return O.pk_order(cols).withColumn("pk", F.array_join("pk", ","))


def assemble_tables(spark, folder):
    part = table(spark, folder, "part")
    tab, col = _expr(TABLE).alias("table"), _expr(COLUMN).alias("column")
    columns = part.select(tab, col, F.col("p_partkey").alias("ord"), _expr(TYPE).alias("type"))
    kind = F.when(F.col("p_size") < 10, "P").when(F.col("p_size") < 20, "U").otherwise("R")
    constraints = part.where("p_size < 20").select(tab, col, F.col("p_partkey").alias("pos"), kind.alias("kind"),
                                                   F.concat(F.lit("K_"), F.when(F.col("p_size") < 10, "PK").otherwise(F.col("p_brand"))).alias("name"))
    checks = part.where("p_size = 40").select(tab, F.concat(F.lit("CK"), F.col("p_partkey").cast("string")).alias("name"),
                                              F.concat(_expr(COLUMN), F.when(F.col("p_type") == "SMALL", " IS NOT NULL").otherwise(" > 0")).alias("condition"))
    indexes = part.where("p_size > 45").select(tab, F.concat(F.lit("IX_"), F.col("p_type")).alias("name"), (F.col("p_brand") == "Brand#1").alias("unique"),
                                               col, F.col("p_partkey").alias("pos"), F.lit("ASC").alias("direction"))
    out = O.assemble_tables(columns, constraints, checks, indexes)
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    return out.select("table", F.md5(F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["column"], c["type"])), ",")).alias("columns"),
                      F.coalesce(F.array_join("pk", ","), F.lit("")).alias("pk"), n("uniques").alias("uniques"), n("checks").alias("checks"),
                      n("indexes").alias("indexes"))


def model_index(spark, folder):
    return O.model_index(database(spark, folder)).select("table", F.md5(F.array_join("columns", ",")).alias("columns"))


def search_model(spark, folder):
    cols = database(spark, folder).select("table", "column", "type", F.col("type").alias("description"), F.lower("table").alias("table_description"))
    return O.search_model(cols, "clob").unionByName(O.search_model(cols, "ring", 20)).unionByName(O.search_model(cols, "C19"))


def structure_vs_table(spark, folder):
    part = table(spark, folder, "part")
    size = F.col("p_size")
    spec = part.select(_expr(TABLE).alias("table"), _expr(COLUMN).alias("column"), _expr(TYPE).alias("type"), size.alias("length"),
                       (size > 5).alias("nullable"), (size == 13).alias("pk"), (size == 14).alias("input_only"))
    have = part.where("p_size <> 8").select(_expr(TABLE).alias("table"), _expr(COLUMN).alias("column"), _expr(TYPE).alias("type"),
                                            F.when(size == 22, size - 1).otherwise(size).alias("length"), (size > 6).alias("nullable"),
                                            ((size == 13) & (F.col("p_brand") != "Brand#6")).alias("pk"))
    return O.structure_vs_table(spec, have)


def table_inventory(spark, folder):
    """Rows of every table, orders and events by their types, and a table that is not there."""
    return O.table_inventory({n: table(spark, folder, n) for n in TABLES} | {"missing": None},
                             {"orders": ("o_orderstatus", "none"), "events": ("event_type", "none")})


QUERIES = {
    "q_schema_drift": schema_drift, "q_drift_labels": drift_labels, "q_env_compare": env_compare,
    "q_compare_indexes": compare_indexes, "q_change_plan": change_plan, "q_model_deviation": model_deviation,
    "q_type_map": type_map, "q_missing_size": missing_size, "q_render_type": render_type, "q_coverage": coverage,
    "q_merge_coverage": merge_coverage, "q_merge_schema": merge_schema, "q_refresh_subset": refresh_subset,
    "q_mark_visibility": mark_visibility, "q_merge_indexes": merge_indexes, "q_merge_relations": merge_relations,
    "q_apply_exclusions": apply_exclusions, "q_dangling_keys": dangling_keys, "q_infer_relations": infer_relations,
    "q_source_statements": source_statements, "q_source_relations": source_relations, "q_source_tables": source_tables,
    "q_access_advice": access_advice, "q_truncation_risk": truncation_risk, "q_pk_order": pk_order,
    "q_assemble_tables": assemble_tables, "q_model_index": model_index, "q_search_model": search_model,
    "q_structure_vs_table": structure_vs_table, "q_table_inventory": table_inventory,
}


def _v(sql):
    return sql.replace("TXT", "VARCHAR")


_NORM = r"upper(regexp_replace(regexp_replace(coalesce({c}, ''), '(?i)\s+(CHAR|BYTE)\s*\)', ')', 'g'), '\s+', '', 'g'))"
_DRIFT = f"""db AS (SELECT {_v(TABLE)} AS t, {_v(COLUMN)} AS c, {_v(TYPE)} AS ty, p_size > 5 AS nu FROM part),
mo AS (SELECT {_v(MODEL_TABLE)} AS t, {_v(MODEL_COLUMN)} AS c, {_v(MODEL_TYPE)} AS ty, coalesce(CASE WHEN p_size = 3 THEN NULL ELSE p_size > 6 END, true) AS nu FROM part),
b AS (SELECT db.ty AS dty, mo.ty AS mty, db.nu AS dnu, mo.nu AS mnu, db.t IS NOT NULL AS ind, mo.t IS NOT NULL AS inm, coalesce(db.t, mo.t) AS t, coalesce(db.c, mo.c) AS c
  FROM db FULL JOIN mo ON db.t = mo.t AND db.c = mo.c),
x AS (SELECT *, t IN (SELECT t FROM db) AS tdb, t IN (SELECT t FROM mo) AS tmo,
  {_NORM.format(c='dty')} AS dn, {_NORM.format(c='mty')} AS mn FROM b),
dr AS (SELECT DISTINCT t AS "table", CASE WHEN tdb AND tmo THEN c END AS "column",
  CASE WHEN NOT tmo THEN 'table only in database' WHEN NOT tdb THEN 'table only in model' WHEN NOT inm THEN 'column only in database'
    WHEN NOT ind THEN 'column only in model' WHEN (dn <> mn AND mn <> '') OR dnu <> mnu THEN 'modified' END AS change,
  CASE WHEN ind AND inm AND dn <> mn AND mn <> '' THEN dty END AS db_type, CASE WHEN ind AND inm AND dn <> mn AND mn <> '' THEN mty END AS model_type,
  CASE WHEN ind AND inm AND dnu <> mnu THEN dnu END AS db_nullable, CASE WHEN ind AND inm AND dnu <> mnu THEN mnu END AS model_nullable FROM x),
drift AS (SELECT * FROM dr WHERE change IS NOT NULL)"""
_LOOSE = _DRIFT.replace(_NORM.format(c='dty'), f"regexp_replace({_NORM.format(c='dty')}, '^NUMBER\\(38\\)$', 'NUMBER')").replace(
    _NORM.format(c='mty'), f"regexp_replace({_NORM.format(c='mty')}, '^NUMBER\\(38\\)$', 'NUMBER')")
_COVER = """cov AS (SELECT c.section, r.real, c.captured, coalesce(e.excluded, 0) AS excluded, CASE WHEN e.excluded IS NULL THEN '' ELSE 'small' END AS reason,
  CASE WHEN r.real IS NULL THEN 0 ELSE greatest(0, r.real - c.captured - coalesce(e.excluded, 0)) END AS gap
  FROM (SELECT p_brand AS section, count(*) AS captured FROM part WHERE p_size > 10 GROUP BY 1) c
  LEFT JOIN (SELECT p_brand AS section, count(*) AS real FROM part WHERE p_brand <> 'Brand#2' GROUP BY 1) r USING (section)
  LEFT JOIN (SELECT p_brand AS section, count(*) AS excluded FROM part WHERE p_size < 9 GROUP BY 1) e USING (section))"""
_OLD = f"""old AS (SELECT {_v(MODEL_TABLE)} AS t, {_v(COLUMN)} AS c, {_v(MODEL_TYPE)} AS ty, p_name AS d, CASE WHEN p_size = 1 THEN true END AS pii,
  CASE WHEN p_size = 2 THEN true END AS safe FROM part WHERE p_size <> 30),
fr AS (SELECT {_v(TABLE)} AS t, {_v(COLUMN)} AS c, {_v(TYPE)} AS ty, p_size > 5 AS nu, CASE WHEN p_size = 50 THEN 1 END AS pk FROM part WHERE p_size <> 31)"""


_SOURCE = """o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_custkey IS NOT NULL),
st AS (SELECT c, k, p, line, kind, sql FROM o JOIN (VALUES
  ('1-URGENT', 0, 'literal', 'SELECT "o".X FROM ORDERS o' || chr(10) || '  JOIN CUSTOMER c ON c.C_CUSTKEY = o.O_CUSTKEY' || chr(10) || '  WHERE o.O_ORDERKEY = <key>'),
  ('2-HIGH', 1, 'literal', 'SELECT <key> FROM LINEITEM l'), ('2-HIGH', 2, 'literal', 'JOIN PART p ON l.L_PARTKEY = p.P_PARTKEY'),
  ('2-HIGH', 1, 'builder', 'SELECT <key> FROM LINEITEM l JOIN PART p ON l.L_PARTKEY = p.P_PARTKEY'),
  ('3-MEDIUM', 0, 'literal', 'UPDATE ORDERS SET X = "a" WHERE K = <key>'), ('4-NOT SPECIFIED', 1, 'literal', 'DELETE FROM EVENTS WHERE K = <key>'),
  ('5-LOW', 0, 'literal', 'SELECT <key> FROM REGION' || chr(10) || '  '), ('5-LOW', 1, 'literal', 'SELECT <key> FROM NATION' || chr(10))) AS v(p, line, kind, sql) USING (p))"""


def _ix(by):
    return (f"SELECT {_v(MODEL_TABLE)} AS t, 'IX' || p_partkey AS n, p_brand || ',' || CASE WHEN p_size = 9 THEN '{by}' ELSE p_type END AS cols, "
            "CASE WHEN p_size = 9 THEN '" + by + "' ELSE p_type END AS c2, p_size > 20 AS u, CASE WHEN p_size > 40 THEN 'manual' ELSE 'db' END AS s FROM part")


ORACLE = {
    "q_schema_drift": f"""WITH {_DRIFT} SELECT "table", "column", change, db_type, model_type, db_nullable::VARCHAR AS db_nullable, model_nullable::VARCHAR AS model_nullable FROM drift""",
    "q_drift_labels": f"""WITH {_LOOSE}, o AS (SELECT DISTINCT {_v(TABLE)} AS t FROM part WHERE p_brand = 'Brand#1')
SELECT "table", "column", CASE change WHEN 'table only in database' THEN CASE WHEN "table" IN (SELECT t FROM o) THEN 'ORPHAN_RECOVERED' ELSE 'NEW_TABLE' END
  WHEN 'table only in model' THEN 'MISSING' WHEN 'column only in database' THEN 'NEW_COL' ELSE 'REMOVED_COL' END AS label FROM drift WHERE change <> 'modified'
UNION ALL SELECT "table", "column", 'TYPE_DIFF' FROM drift WHERE change = 'modified' AND model_type IS NOT NULL
UNION ALL SELECT "table", "column", 'NULLABLE_DIFF' FROM drift WHERE change = 'modified' AND model_nullable IS NOT NULL""",
    "q_env_compare": f'WITH {_DRIFT} SELECT "table", change, count(*) AS differences FROM drift GROUP BY ALL',
    "q_compare_indexes": f"""WITH a AS (SELECT * FROM ({_ix('X')}) WHERE c2 <> 'PROMO'), b AS (SELECT * FROM ({_ix('Y')}) WHERE c2 <> 'LARGE')
SELECT coalesce(a.t, b.t) AS "table", coalesce(a.n, b.n) AS name, CASE WHEN b.t IS NULL THEN 'only in a' WHEN a.t IS NULL THEN 'only in b' ELSE 'different' END AS change
FROM a FULL JOIN b ON a.t = b.t AND a.n = b.n WHERE a.t IS NULL OR b.t IS NULL OR a.cols <> b.cols""",
    "q_change_plan": f"""WITH {_DRIFT}, cr AS (SELECT "table" FROM drift WHERE change = 'table only in model')
SELECT CASE change WHEN 'table only in model' THEN 'CREATE_TABLE' WHEN 'column only in model' THEN 'ADD_COLUMN' WHEN 'modified' THEN 'MODIFY_COLUMN' ELSE 'DROP_COLUMN_CANDIDATE' END AS operation,
  "table", "column", CASE WHEN change = 'modified' THEN concat_ws(' null=', db_type, db_nullable::VARCHAR) END AS "from",
  CASE WHEN change = 'modified' THEN concat_ws(' null=', model_type, model_nullable::VARCHAR) END AS "to" FROM drift WHERE change <> 'table only in database'
UNION ALL SELECT 'ADD_FK', {_v(MODEL_TABLE)}, upper({_v(MODEL_COLUMN)}), NULL, 'PARTS.' || upper(p_brand) FROM part WHERE p_size = 20 AND {_v(MODEL_TABLE)} IN (SELECT "table" FROM cr)
UNION ALL SELECT 'CREATE_INDEX', t, NULL, NULL, n || '(' || cols || ')' FROM ({_ix('X')}) WHERE t IN (SELECT "table" FROM cr)""",
    "q_model_deviation": f"""WITH {_DRIFT}, l AS (SELECT DISTINCT change, concat_ws('.', "table", "column") AS name FROM drift),
r AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY name) AS rn FROM l)
SELECT change, count(*) AS count, string_agg(name, ',' ORDER BY name) FILTER (rn <= 10) AS names FROM r GROUP BY change""",
    "q_type_map": f"""SELECT {_v(TABLE)} AS "table", {_v(COLUMN)} AS "column", CASE p_type WHEN 'SMALL' THEN 'VARCHAR(' || p_size || ' CHAR)' WHEN 'MEDIUM' THEN 'DECIMAL(' || p_size || ',2)'
  WHEN 'STANDARD' THEN 'DECIMAL(18,2)' WHEN 'ECONOMY' THEN 'DATETIME2' WHEN 'LARGE' THEN 'CHAR' ELSE 'VARBINARY' END AS sqlserver, 'NUMBER(19)' AS key_type,
  CASE p_type WHEN 'SMALL' THEN 'VARCHAR2(' || p_size || ')' WHEN 'MEDIUM' THEN 'NUMBER(' || p_size || ',2)' WHEN 'STANDARD' THEN 'NUMBER' WHEN 'ECONOMY' THEN 'DATE'
  WHEN 'LARGE' THEN 'CHAR' ELSE 'RAW' END AS normal FROM part""",
    "q_missing_size": f"""SELECT {_v(TABLE)} AS "table", {_v(COLUMN)} AS "column", CASE p_type WHEN 'LARGE' THEN 'silent' ELSE 'invalid' END AS problem FROM part WHERE p_type IN ('LARGE', 'PROMO')""",
    "q_render_type": """SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN CASE WHEN p_size % 2 = 0 THEN 'VARCHAR2(' || p_size || ' CHAR)' WHEN p_size > 10 THEN 'VARCHAR2(' || p_size || ' BYTE)' ELSE 'VARCHAR2' END
  WHEN 'MEDIUM' THEN CASE WHEN p_size = 20 THEN 'NUMBER' WHEN p_size % 3 <> 0 THEN 'NUMBER(' || p_size || ',' || (p_size % 3) || ')' ELSE 'NUMBER(' || p_size || ')' END
  WHEN 'LARGE' THEN CASE WHEN p_size > 10 THEN 'RAW(' || p_size || ')' ELSE 'RAW' END ELSE 'DATE' END AS rendered,
  CASE p_type WHEN 'SMALL' THEN 'VARCHAR2(' || p_size || ')' WHEN 'MEDIUM' THEN CASE WHEN p_size % 3 > 0 THEN 'NUMBER(' || p_size || ',' || (p_size % 3) || ')' ELSE 'NUMBER(' || p_size || ')' END
  WHEN 'LARGE' THEN 'RAW' ELSE 'DATE' END AS built FROM part""",
    "q_coverage": f"WITH {_COVER} SELECT section, real::VARCHAR AS real, captured, excluded, reason, gap FROM cov",
    "q_merge_coverage": f"""WITH {_COVER} SELECT section, real::VARCHAR AS real, CASE WHEN section = 'Brand#3' THEN 0 ELSE captured END AS captured, excluded, reason,
  CASE WHEN section = 'Brand#3' THEN greatest(0, coalesce(real, 0) - excluded) ELSE gap END AS gap, CASE WHEN section = 'Brand#3' THEN 'tables' ELSE 'objects' END AS origin,
  CASE WHEN section = 'Brand#3' THEN '2026-01-01' ELSE '2026-02-01' END AS date FROM cov""",
    "q_merge_schema": f"""WITH {_OLD} SELECT coalesce(f.t, o.t) AS "table", coalesce(f.c, o.c) AS "column", CASE WHEN f.t IS NOT NULL THEN f.ty ELSE o.ty END AS type,
  (CASE WHEN f.t IS NOT NULL THEN f.nu ELSE true END)::VARCHAR AS nullable, f.pk::VARCHAR AS pk_pos, coalesce(o.d, '') AS description, o.pii::VARCHAR AS pii, o.safe::VARCHAR AS safe,
  CASE WHEN f.t IS NOT NULL THEN 'db' ELSE 'kept' END AS source
FROM old o FULL JOIN fr f ON o.t = f.t AND o.c = f.c WHERE f.t IS NOT NULL OR o.t NOT IN (SELECT t FROM fr)""",
    "q_refresh_subset": f"""WITH {_OLD}, w AS (SELECT DISTINCT {_v(TABLE)} AS t FROM part WHERE p_name LIKE 'red%' UNION SELECT upper(n_name) FROM nation),
p AS (SELECT DISTINCT t FROM fr WHERE t IN (SELECT t FROM w)),
o AS (SELECT t, d FROM old WHERE t NOT IN (SELECT t FROM p) UNION ALL SELECT t, '' FROM fr WHERE t IN (SELECT t FROM p)),
a AS (SELECT t, count(*) AS columns, count(*) FILTER (d <> '') AS described FROM o GROUP BY t)
SELECT coalesce(w.t, a.t) AS "table", CASE WHEN w.t IS NULL THEN NULL WHEN w.t IN (SELECT t FROM p) THEN 'updated' ELSE 'not_in_db' END AS status, a.columns::VARCHAR AS columns, a.described::VARCHAR AS described
FROM w FULL JOIN a ON w.t = a.t""",
    "q_mark_visibility": f"""SELECT "table", CASE WHEN gone THEN 'false' END AS visible, CASE WHEN gone THEN '2026-03-01' END AS visible_check
FROM (SELECT DISTINCT {_v(MODEL_TABLE)} AS "table", p_name LIKE 'hot%' AS gone FROM part)""",
    "q_merge_indexes": f"""WITH o AS ({_ix('X')}), d AS (SELECT * FROM ({_ix('Y')}) WHERE t LIKE 'RED%')
SELECT t AS "table", n AS name, cols AS columns, u AS "unique", s AS source FROM o WHERE s = 'manual' OR t NOT IN (SELECT t FROM d)
UNION ALL SELECT t, n, cols, u, 'db' FROM d""",
    "q_merge_relations": """WITH o AS (SELECT l_partkey AS a, l_linenumber AS b, l_suppkey AS c, l_returnflag AS d, l_orderkey AS k, l_extendedprice AS e, l_linestatus = 'F' AS m, l_quantity > 5 AS old
  FROM lineitem WHERE l_quantity > 5 OR l_linestatus <> 'F'),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, c, d ORDER BY old, k DESC, e DESC) AS rn FROM o WHERE NOT m AND (a, b, c, d) NOT IN (SELECT (a, b, c, d) FROM o WHERE m))
SELECT a AS source_table, b AS source_column, c AS target_table, d AS target_column, 'manual' AS source, k AS row_key FROM o WHERE m
UNION ALL SELECT a, b, c, d, 'log', k FROM r WHERE rn = 1""",
    "q_apply_exclusions": """SELECT 'T' || p_partkey || s AS "table", CASE WHEN p_size = 1 THEN CASE WHEN p_brand <> 'Brand#1' THEN p_brand ELSE 'no reason given' END END AS reason,
  p_size = 1 AS excluded, p_size <> 1 AND s <> '' AS suspicious FROM (SELECT *, CASE p_type WHEN 'PROMO' THEN '_BAK' WHEN 'SMALL' THEN '_20260731' ELSE '' END AS s FROM part)""",
    "q_dangling_keys": """WITH k AS (SELECT p_partkey FROM part WHERE p_size > 3)
SELECT 't' || l_partkey AS "table", 'T' || l_suppkey AS ref_table, count(*) AS keys FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM k) AND l_suppkey NOT IN (SELECT p_partkey FROM k) GROUP BY ALL""",
    "q_infer_relations": """SELECT 'ORDERS' AS source_table, 'O_CUSTKEY' AS source_column, 'CUSTOMER' AS target_table, 'C_CUSTKEY' AS target_column,
  'JoinClause' AS inferred_from, 'high' AS confidence, count(*) AS statements FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' HAVING count(*) > 0""",
    "q_source_statements": f"""WITH {_SOURCE} SELECT 'F' || c || '.cs' AS file, k * 10 + line AS line_no, kind, replace(sql, '<key>', k::VARCHAR) AS sql FROM st""",
    "q_source_relations": f"""WITH {_SOURCE} SELECT source_table, source_column, target_table, target_column, 'JoinClause' AS inferred_from, 'high' AS confidence, count(*) AS statements
FROM st JOIN (VALUES ('1-URGENT', 'literal', 'CUSTOMER', 'C_CUSTKEY', 'ORDERS', 'O_CUSTKEY'), ('2-HIGH', 'builder', 'LINEITEM', 'L_PARTKEY', 'PART', 'P_PARTKEY'))
  AS r(p, kind, source_table, source_column, target_table, target_column) USING (p, kind) GROUP BY ALL""",
    "q_source_tables": f"""WITH {_SOURCE} SELECT t AS "table", count(*) AS statements
FROM (SELECT unnest(list_distinct(regexp_extract_all(sql, '(?:FROM|JOIN|UPDATE) ([A-Z]+)', 1))) AS t FROM st) GROUP BY t""",
    "q_access_advice": """WITH n AS (SELECT (SELECT count(*) FROM orders) >= 100 AS ob, (SELECT count(*) FROM customer) >= 100 AS cb)
SELECT o_orderkey AS id, t AS "table", f AS finding, s AS severity FROM orders, n, (VALUES
  ('2-HIGH', NULL, 'CUSTOMER', 'no supporting column', 'high'),
  ('3-MEDIUM', NULL, 'ORDERS', 'leading column not used', 'medium'), ('3-MEDIUM', NULL, 'ORDERS', 'select all', 'medium'),
  ('4-NOT SPECIFIED', NULL, 'ORDERS', 'filter on an expression', 'medium'), ('4-NOT SPECIFIED', NULL, 'CUSTOMER', 'filter on an expression', 'medium'),
  ('4-NOT SPECIFIED', NULL, 'ORDERS', 'select all', 'medium'), ('4-NOT SPECIFIED', NULL, 'CUSTOMER', 'select all', 'medium'),
  ('4-NOT SPECIFIED', NULL, 'ORDERS', 'unsupported sort', 'low'), ('4-NOT SPECIFIED', NULL, 'CUSTOMER', 'unsupported sort', 'low')) AS v(p, st, t, f, s)
WHERE o_orderpriority = p AND ob AND cb""",
    "q_truncation_risk": """SELECT 'text' AS "column", max(length(text)) AS longest, count(*) FILTER (text IS NULL) AS nulls, 4000::BIGINT AS declared, max(length(text)) > 4000 AS too_long, false AS loses_digits, count(*) FILTER (text IS NULL) > 0 AS null_in_required FROM documents
UNION ALL SELECT 'lang', max(length(lang)), count(*) FILTER (lang IS NULL), 2, max(length(lang)) > 2, false, count(*) FILTER (lang IS NULL) > 0 FROM documents
UNION ALL SELECT 'source', max(length(source)), count(*) FILTER (source IS NULL), 5, max(length(source)) > 5, false, false FROM documents
UNION ALL SELECT 'p_name', max(length(p_name)), count(*) FILTER (p_name IS NULL), 12, max(length(p_name)) > 12, false, count(*) FILTER (p_name IS NULL) > 0 FROM part
UNION ALL SELECT 'p_type', max(length(p_type)), count(*) FILTER (p_type IS NULL), 8, max(length(p_type)) > 8, false, false FROM part
UNION ALL SELECT 'o_totalprice', max(length(regexp_replace(o_totalprice::VARCHAR, '\\.0$', ''))), count(*) FILTER (o_totalprice IS NULL), 7, false, max(length(floor(abs(o_totalprice))::BIGINT::VARCHAR)) > 5, false FROM orders
UNION ALL SELECT 'o_custkey', max(length(o_custkey::VARCHAR)), count(*) FILTER (o_custkey IS NULL), 9, false, max(length(o_custkey::VARCHAR)) > 9, false FROM orders""",
    "q_pk_order": f"""WITH k AS (SELECT {_v(TABLE)} AS t, {_v(COLUMN)} AS c, p_partkey, p_brand = 'Brand#5' AS pos FROM part WHERE p_brand IN ('Brand#4', 'Brand#5')),
m AS (SELECT t, bool_or(pos) AS s, bool_or(NOT pos) AS p FROM k GROUP BY t)
SELECT t AS "table", string_agg(c, ',' ORDER BY CASE WHEN s AND NOT p THEN -p_partkey ELSE p_partkey END) AS pk, s AND p AS ambiguous FROM k JOIN m USING (t) GROUP BY t, s, p""",
    "q_assemble_tables": f"""SELECT {_v(TABLE)} AS "table", md5(string_agg({_v(COLUMN)} || ' ' || {_v(TYPE)}, ',' ORDER BY p_partkey)) AS columns,
  coalesce(string_agg({_v(COLUMN)}, ',' ORDER BY p_partkey) FILTER (p_size < 10), '') AS pk, count(DISTINCT p_brand) FILTER (p_size BETWEEN 10 AND 19) AS uniques,
  count(*) FILTER (p_size = 40 AND p_type <> 'SMALL') AS checks, count(DISTINCT p_type) FILTER (p_size > 45) AS indexes FROM part GROUP BY 1""",
    "q_model_index": f"""SELECT {_v(TABLE)} AS "table", md5(string_agg({_v(COLUMN)}, ',' ORDER BY {_v(COLUMN)})) AS columns FROM part GROUP BY 1""",
    "q_search_model": f"""WITH d AS (SELECT {_v(TABLE)} AS t, {_v(COLUMN)} AS c, upper({_v(TYPE)}) AS ty FROM part),
k AS (SELECT * FROM (VALUES ('CLOB', 100), ('RING', 20), ('C19', 100)) AS v(w, most)),
h AS (SELECT w, most, t, bool_or(contains(t, w)) AS match_table_name, count(*) FILTER (contains(c, w) OR contains(ty, w)) AS matching_columns FROM d, k GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY t) AS rn, count(*) OVER (PARTITION BY w) AS total FROM h WHERE match_table_name OR matching_columns > 0)
SELECT t AS "table", match_table_name, matching_columns, total::INTEGER AS total, total > most AS truncated FROM g WHERE rn <= most""",
    "q_structure_vs_table": f"""WITH p AS (SELECT {_v(TABLE)} AS t, {_v(COLUMN)} AS c, {_v(TYPE)} AS ty, * FROM part),
k AS (SELECT t, string_agg(c, ',' ORDER BY c) AS pk, string_agg(c, ',' ORDER BY c) FILTER (p_brand <> 'Brand#6') AS tpk FROM p WHERE p_size = 13 GROUP BY t)
SELECT t AS "table", c AS "column", 'ADD_COLUMN' AS operation, ty AS detail FROM p WHERE p_size = 8
UNION ALL SELECT t, c, 'WIDEN_COLUMN', p_size::VARCHAR FROM p WHERE p_size = 22
UNION ALL SELECT t, c, 'CHANGE_NULLABLE', 'true' FROM p WHERE p_size = 6
UNION ALL SELECT t, NULL, CASE WHEN tpk IS NULL THEN 'ADD_PRIMARY_KEY' ELSE 'REVIEW_PRIMARY_KEY' END, pk FROM k WHERE pk IS DISTINCT FROM tpk""",
    "q_table_inventory": " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", 'row' AS type, count(*) AS objects, CASE WHEN count(*) > 0 THEN 'data' ELSE 'empty' END AS status FROM {n}" for n in TABLES if n not in ("orders", "events"))
        + " UNION ALL SELECT 'orders', coalesce(o_orderstatus, 'none'), count(*), 'data' FROM orders GROUP BY 2"
        + " UNION ALL SELECT 'events', coalesce(event_type, 'none'), count(*), 'data' FROM events GROUP BY 2 UNION ALL SELECT 'missing', NULL, NULL, 'unreadable'",
}
