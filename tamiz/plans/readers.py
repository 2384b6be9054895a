"""Registered queries: the parsing halves of the readers, and the guards of masked results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tamiz.functions import personal as P
from tamiz.functions.fixed_values import CONTROL_LETTERS
from tamiz.operators import catalog as K, guard, history as H, personal as O, stats as T, textsearch as X, validate as C
from tamiz.plans.base import CATALOG_SCHEMA, DEMO_KEY, catalog_of, hmac_sql
from tamiz.plans.personal import POLICY
from tamiz.session import local_rows, shared_folder, table
from tamiz.sources import documents as D
from tamiz.sources.text import decoded, read_lines


def _text(c):
    return F.col(c).cast("string")


def lines_encoded(spark, folder):
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    rows = table(spark, folder, "documents").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", F.md5(decoded(F.col("raw"), F.is_valid_utf8(F.col("raw").cast("string")))).alias("digest"))


def lines_numbered(spark, folder):
    """Order lines written as text, each with its place in its file, and read back over file blocks: how many have that number."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1
    table(spark, folder, "lineitem").select(F.rpad(F.concat_ws(" ", place, "l_linenumber", "l_orderkey"), 200, ".").alias("value")).write.text(path)
    cell = lambda i: F.split_part("text", F.lit(" "), F.lit(i)).cast("long")
    lines = read_lines(spark, path).select("line_no", cell(1).alias("place"), cell(2).alias("l_linenumber"), F.length("text").alias("n"))
    return lines.groupBy("l_linenumber").agg(F.count("*").alias("lines"), F.count_if((F.col("line_no") == F.col("place")) & (F.col("n") == 200)).alias("in_place"))


def error_xml(spark, folder):
    key = _text("o_orderkey")
    doc = F.concat(F.lit('<error time="2026-01-01T00:00:00" type="App.'), "o_orderstatus", F.lit('Exception" message="order '), key,
                   F.lit('" detail="'), F.repeat(F.lit("at App.Step()&#10;"), (F.col("o_orderkey") % 30).cast("int")), F.lit('end"/>'))
    # Every seventh document is cut off.
    texts = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.substring(doc, 1, 60)).otherwise(doc).alias("value"))
    events = D.parse_error_xml(texts, keep=("o_orderkey",))
    return events.select("o_orderkey", "kind", "stamp", F.col("lines")[0].alias("head"), F.size("lines").cast("bigint").alias("n_lines"))


def _results(spark, folder):
    o = table(spark, folder, "orders")
    one = F.concat(F.lit('<UnitTestResult testName="t'), _text("o_orderkey"), F.lit('" outcome="'), F.when(F.col("o_orderstatus") == "F", "Failed").otherwise("Passed"),
                   F.lit('">'), F.when(F.col("o_orderstatus") == "F", F.lit("<Output><ErrorInfo><Message>a &lt; b</Message><StackTrace>at x</StackTrace></ErrorInfo></Output>")).otherwise(""),
                   F.lit("</UnitTestResult>"))
    # A run is a customer; the orders of one customer are few.
    per = o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("body"), F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    doc = F.concat(F.lit('<TestRun xmlns="urn:runs"><Results>'), "body", F.lit('</Results><ResultSummary><Counters total="'), _text("n"), F.lit('" failed="'), _text("f"), F.lit('"/></ResultSummary></TestRun>'))
    cut = F.when(F.col("o_custkey") % 5 == 0, F.substring_index(doc, "<ResultSummary>", 1)).otherwise(doc)
    return D.parse_test_results(per.select("o_custkey", cut.alias("value")), keep=("o_custkey",))


def test_results(spark, folder):
    counters, results = _results(spark, folder)
    seen = results.groupBy("o_custkey").agg(F.count("*").alias("results"), F.count_if(F.col("outcome") == "Failed").alias("failed_results"),
                                            F.count_if(F.col("message") == "a < b").alias("messages"))
    return counters.select("o_custkey", "total", "failed").join(seen, "o_custkey", "left")


def catalog_json(spark, folder):
    """Both shapes: customers with an even key describe their table as an object, others as lists."""
    key = _text("c_custkey")
    column = F.concat(F.lit('"type": "NUMBER(10)", "pk": '), F.when(F.col("c_custkey") % 3 == 0, "true").when(F.col("c_custkey") % 3 == 1, "2").otherwise("false"),
                      F.when(F.col("c_acctbal") < 0, F.lit(', "pii": true')).otherwise(""))
    named = F.concat(F.lit('{"tables": {"t'), key, F.lit('": {"columns": {"a": {'), column, F.lit("}}}}}"))
    listed = F.concat(F.lit('﻿{"tables": [{"tableName": "t'), key, F.lit('", "columns": [{"name": "a", '), column, F.lit("}]}, 7]}"))
    texts = table(spark, folder, "customer").select(F.when(F.col("c_custkey") % 2 == 0, named).otherwise(listed).alias("value"))
    return D.parse_catalog(texts).select("table", "column", "type", "pk_flag", "pk_pos", "pii", "safe")


def history_parse(spark, folder):
    key = _text("c_custkey")
    run = lambda i: F.concat(F.lit('{"id": "'), key, F.lit(f"-{i}"), F.lit('", "solution": "'), "c_mktsegment", F.lit('", "agents": ["a", "b"]}'))
    array = F.concat(F.lit("["), run(1), F.lit(",\n"), run(2), F.lit(', {"task": "no id"}]'))
    lines = F.concat(run(1), F.lit("\n\nbroken\n"), run(2), F.lit("\n"))
    value = F.when(F.col("c_custkey") % 3 == 0, array).when(F.col("c_custkey") % 3 == 1, lines).otherwise(F.concat(F.lit("["), run(1)))
    return D.parse_history(table(spark, folder, "customer").select(value.alias("value"))).select("id", "solution", F.size("agents").cast("bigint").alias("agents"))


def extract_controls(spark, folder):
    key, group = _text("page_id"), (F.col("page_id") % 50).cast("string")
    rs = F.concat(F.when(F.col("page_id") % 2 == 0, F.lit('<rs:Label runat="server" ID="L')).otherwise(F.lit('<RS:label Runat="server" id="L')), group,
                  F.when(F.col("page_id") % 2 == 0, F.lit('" Text="')).otherwise(F.lit('" text="')), F.lit('label"/>'))
    asp = F.concat(F.lit('<asp:Button ID="B'), group, F.lit('" Text="press"/>'))
    turned = F.concat(F.lit('<rs:TextBox Text="turned" ID="T'), group, F.lit('"/>'))
    lines = table(spark, folder, "pages").select(F.concat(F.lit("p"), key).alias("file"), F.col("page_id").alias("line_no"),
                                                 F.concat(F.lit("<td>"), rs, asp, F.when(F.col("page_id") % 4 == 0, turned).otherwise("")).alias("text"))
    return X.extract_controls(lines)


def gate(spark, folder):
    ident = F.expr(f"""lpad(CAST(c_custkey AS STRING), 8, '0') ||
      substr('{CONTROL_LETTERS}', CAST((c_custkey + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) % 23 + 1 AS INTEGER), 1)""")
    note = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("mail "), _text("c_custkey"), F.lit("@shop.example"))).otherwise(F.concat(F.lit("cliente "), ident))
    rows = table(spark, folder, "customer").select(F.concat("c_mktsegment", F.lit("/"), _text("c_custkey")).alias("path"), note.alias("note"))
    exempt = ("BUILDING/",)
    stopped = rows.select(O.gate_reason("note", "path", exempt).alias("form"))
    # The rows that pass run through the gate itself, which fails on any other.
    passed = O.personal_data_gate(rows.where(O.gate_reason("note", "path", exempt).isNull()), "note", "path", exempt)
    return (stopped.where("form IS NOT NULL").groupBy("form").agg(F.count("*").alias("rows"))
            .unionByName(passed.agg(F.count("*").alias("rows")).select(F.lit("passed").alias("form"), "rows")))


def mask_numeric_types(spark, folder):
    phone = F.col("c_custkey") + 600000000
    sheet = table(spark, folder, "customer").select("c_custkey", phone.alias("as_long"), phone.cast("double").alias("as_double"), phone.cast("decimal(38,10)").alias("as_decimal"),
                                                    phone.cast("string").alias("as_text"), (phone + 0.25).cast("double").alias("amount"))
    catalog = catalog_of(spark, folder, ["customer"])
    masked, _ = O.mask(sheet, ["CUSTOMER"], catalog, POLICY, DEMO_KEY)
    return masked


def guarded_quoted_names(spark, folder):
    table(spark, folder, "customer").createOrReplaceTempView("customer")
    catalog = catalog_of(spark, folder, ["customer"]).withColumn("pii", F.col("column") == "C_NATIONKEY")
    sql = "SELECT `c_custkey`, c_nationkey, `c_name`, \"x -- y\" AS tag, 'it\\'s' AS quoted FROM (`customer`)"
    return guard.guarded_query(spark, sql, catalog, POLICY, DEMO_KEY, max_rows=None)[0]


RENAMED = """
WITH w AS (SELECT c_custkey AS id, c_nationkey AS x FROM customer),
u AS (SELECT s_suppkey AS id, s_nationkey AS x FROM supplier UNION ALL SELECT id, x FROM w)
SELECT id % 50 AS part, min(x) AS s_suppkey, sum(x + 0) AS total, count(x) AS n, count(DISTINCT x) AS kinds, max(id) AS highest,
       max(CASE WHEN x > 12 THEN 1 ELSE 0 END) AS high, (SELECT max(c_nationkey) FROM customer) AS top
FROM u GROUP BY id % 50"""


def guarded_renamed(spark, folder):
    """One masked column under other names: a common table, the second branch of a union, aggregates, a sub-select, a name that a clear column has."""
    for name in ("customer", "supplier"):
        table(spark, folder, name).createOrReplaceTempView(name)
    catalog = catalog_of(spark, folder, ["customer", "supplier"]).withColumn("pii", F.col("column") == "C_NATIONKEY")
    masked, report = guard.guarded_query(spark, RENAMED, catalog, POLICY, DEMO_KEY, max_rows=None)
    return masked.withColumn("masked", F.lit(",".join(report.masked))).withColumn("tables", F.lit(",".join(sorted(report.tables))))


def guarded_capped(spark, folder):
    table(spark, folder, "customer").createOrReplaceTempView("customer")
    masked, report = guard.guarded_query(spark, "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey", catalog_of(spark, folder, ["customer"]), POLICY, DEMO_KEY, max_rows=100)
    return masked.select("*", F.lit(report.row_count).cast("bigint").alias("row_count"), F.lit(report.rows_truncated).alias("rows_truncated"))


def numeric_precision(spark, folder):
    price = F.format_string("%.2f", "o_totalprice")
    # Every third price loses its decimals, every fifth a digit of them.
    text = F.when(F.col("o_orderkey") % 3 == 0, F.substring_index(price, ".", 1)).when(F.col("o_orderkey") % 5 == 0, F.expr("substr(price, 1, length(price) - 1)")).otherwise(price)
    rows = table(spark, folder, "orders").withColumn("price", price).select(F.lit("f").alias("file"), F.col("o_orderkey").alias("line_no"), text.alias("price"))
    spec = C.Structure("s", fields=(C.Field("price", "decimal", decimales=2, decimales_obligatorios=True, precision=7),))
    return C.check_rows(rows, spec).select("line_no", "field", "rule", "value")


def layers(spark, folder):
    end = F.when(F.col("p_size") % 5 == 0, "Dalc").when(F.col("p_size") % 5 == 1, "Web").when(F.col("p_size") % 5 == 2, "Common").when(F.col("p_size") % 5 == 3, "Tests").otherwise("")
    name = F.concat(F.when(F.col("p_partkey") % 7 == 0, "Bus").otherwise("App"), F.col("p_type"), end)
    return table(spark, folder, "part").select(H.layer_of(name).alias("layer")).groupBy("layer").agg(F.count("*").alias("projects"))


def phrase_repeats_whole(spark, folder):
    """Rows with equal keys and rows without keys, against phrases with and without inner words."""
    o = table(spark, folder, "orders")
    lines = o.select(F.when(F.col("o_orderkey") % 4 != 0, F.lit("f")).alias("file"), (F.col("o_orderkey") % 3).alias("line_no"),
                     F.concat(F.lit("note about customer"), _text("o_custkey"), F.lit(" and their order "), "o_orderpriority").alias("text"))
    phrases = table(spark, folder, "customer").select(F.concat(F.lit("about customer"), _text("c_custkey"), F.lit(" and")).alias("phrase"))
    phrases = phrases.union(table(spark, folder, "nation").select(F.concat(F.lit("customer"), F.lpad(_text("n_nationkey"), 4, "1")).alias("phrase")))
    return O.contains_phrase(lines, phrases, ["file", "line_no"]).groupBy("file", "line_no", "phrase").agg(F.count("*").alias("rows"))


def _contacts(spark, folder):
    """A sheet whose clear columns hold personal values: a safe column of phones, a safe column of codes, named ones."""
    phone = F.when(F.col("c_custkey") % 3 == 0, F.lit("s/n")).otherwise(F.concat(F.lit("6"), F.lpad(_text("c_custkey"), 8, "0")))
    return table(spark, folder, "customer").select(phone.alias("extra"), F.lpad(_text("c_custkey"), 6, "0").alias("code"), "c_acctbal", F.col("c_name").alias("telefono_movil"))


def inventory_suspects(spark, folder):
    rows = [("CONTACTS", "EXTRA", "VARCHAR(20)", True), ("CONTACTS", "CODE", "VARCHAR(6)", True), ("CONTACTS", "C_ACCTBAL", "DECIMAL(12,2)", None),
            ("CONTACTS", "TELEFONO_MOVIL", "NUMBER(9)", None), ("CONTACTS", "REMARKS", "VARCHAR(200)", None)]
    catalog = local_rows(spark, [(t, c, k, True, None, None, None, None, safe) for t, c, k, safe in rows], CATALOG_SCHEMA)
    sheet = _contacts(spark, folder)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), P.as_text(F.col(c), k).alias("value")) for c, k in sheet.dtypes])
    inventory = O.column_inventory(catalog, POLICY, sheet.select(F.lit("contacts").alias("table"), F.inline(cells)))
    return inventory.select("table", "column", "verdict", "reason", "form", "hits", "sampled", "suspect")


def sample_columns(spark, folder):
    return O.sample_columns(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice"), "orders", 500, ["o_totalprice", "o_orderkey"])


def failed_tests(spark, folder):
    results = _results(spark, folder)[1].withColumn("file", _text("o_custkey"))
    return T.failures(results).groupBy("file").agg(F.count("*").alias("failed"), F.max("message").alias("message"), F.max("stack").alias("stack"))


def table_schema(spark, folder):
    """Columns of the tables named by brands, and names that are not known."""
    cols = table(spark, folder, "part").select(F.upper("p_brand").alias("table"), F.concat(F.lit("C"), _text("p_partkey")).alias("column"))
    names = table(spark, folder, "part").where("p_size <= 10").select(F.lower(F.when(F.col("p_size") > 5, F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_brand"))).alias("table"))
    found, missing = K.table_schema(cols, names)
    return found.groupBy("table").agg(F.count("*").alias("columns")).unionByName(missing.select("table", F.lit(0).cast("bigint").alias("columns")))


def coverage_notes(spark, folder):
    """Orders by status: those of low keys are captured, of some keys excluded, and the gap is told to the owner and to others."""
    o = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("section"), "o_orderkey")
    per = lambda where, name: o.where(where).groupBy("section").agg(F.count("*").alias(name))
    cov = K.coverage(per("true", "real"), per("o_orderkey % 10 <> 0", "captured"), per("o_orderkey % 20 = 0", "excluded").withColumn("reason", F.lit("system")))
    return K.coverage_note(cov, True).withColumn("owner", F.lit(True)).unionByName(K.coverage_note(cov, False).withColumn("owner", F.lit(False)))


QUERIES = {
    "q_inventory_suspects": inventory_suspects, "q_sample_columns": sample_columns, "q_failed_tests": failed_tests, "q_table_schema": table_schema,
    "q_coverage_notes": coverage_notes,
    "q_lines_numbered": lines_numbered, "q_lines_encoded": lines_encoded, "q_error_xml": error_xml, "q_test_results": test_results, "q_catalog_json": catalog_json, "q_history_parse": history_parse,
    "q_extract_controls": extract_controls, "q_gate": gate, "q_mask_numeric_types": mask_numeric_types, "q_guarded_quoted_names": guarded_quoted_names,
    "q_guarded_capped": guarded_capped, "q_guarded_renamed": guarded_renamed, "q_numeric_precision": numeric_precision, "q_layers": layers,
    "q_phrase_repeats_whole": phrase_repeats_whole,
}


def _pseudonym(domain: str, value: str) -> str:
    return "'pii:' || substr(" + hmac_sql(f"'{domain}|' || {value}", DEMO_KEY) + ", 1, 12)"


_PHONE = "CAST(c_custkey + 600000000 AS VARCHAR)"
ORACLE = {
    "q_inventory_suspects": """WITH p AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 3 <> 0) AS phones FROM customer)
SELECT 'CONTACTS' AS "table", 'EXTRA' AS "column", CASE WHEN 2 * phones >= n THEN 'mask' ELSE 'clear' END AS verdict, CASE WHEN 2 * phones >= n THEN 'form telefono' ELSE 'flag' END AS reason,
  CASE WHEN 2 * phones >= n THEN 'telefono' END AS form, CASE WHEN 2 * phones >= n THEN phones END AS hits, CASE WHEN 2 * phones >= n THEN n END AS sampled, 2 * phones >= n AS suspect FROM p
UNION ALL SELECT 'CONTACTS', 'CODE', 'clear', 'flag', NULL, NULL, NULL, false UNION ALL SELECT 'CONTACTS', 'C_ACCTBAL', 'clear', 'type', NULL, NULL, NULL, false
UNION ALL SELECT 'CONTACTS', 'TELEFONO_MOVIL', 'mask', 'name', NULL, NULL, NULL, false UNION ALL SELECT 'CONTACTS', 'REMARKS', 'mask', 'text', NULL, NULL, NULL, false""",
    "q_sample_columns": """WITH o AS (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 500)
SELECT 'orders' AS "table", 'o_orderkey' AS "column", o_orderkey::VARCHAR AS value FROM o UNION ALL SELECT 'orders', 'o_orderstatus', o_orderstatus FROM o
UNION ALL SELECT 'orders', 'o_custkey', o_custkey::VARCHAR FROM o UNION ALL SELECT 'orders', 'o_totalprice', regexp_replace(o_totalprice::DECIMAL(18,2)::VARCHAR, '\\.?0+$', '') FROM o""",
    "q_failed_tests": """SELECT o_custkey::VARCHAR AS file, count(*) AS failed, 'a < b' AS message, 'at x' AS stack FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 5 <> 0 GROUP BY 1""",
    "q_table_schema": """WITH w AS (SELECT DISTINCT upper(CASE WHEN p_size > 5 THEN p_brand || 'x' ELSE p_brand END) AS t FROM part WHERE p_size <= 10),
c AS (SELECT upper(p_brand) AS t, count(*) AS n FROM part GROUP BY 1) SELECT w.t AS "table", coalesce(n, 0) AS columns FROM w LEFT JOIN c ON c.t = w.t""",
    "q_coverage_notes": """WITH g AS (SELECT sum(greatest(0, r - c - coalesce(e, 0)))::BIGINT AS gaps FROM (SELECT o_orderstatus, count(*) AS r, count(*) FILTER (o_orderkey % 10 <> 0) AS c,
  count(*) FILTER (o_orderkey % 20 = 0) AS e FROM orders GROUP BY 1))
SELECT gaps, gaps > 0 AS partial, CASE WHEN gaps > 0 THEN 'owner account: the gap is a filter, not a permission' ELSE '' END AS note, true AS owner FROM g
UNION ALL SELECT gaps, gaps > 0, CASE WHEN gaps > 0 THEN 'not the owner: an object may exist without a grant; nothing was removed' ELSE 'not the owner, but the count matches the dictionary' END, false FROM g""",
    "q_lines_numbered": "SELECT l_linenumber::BIGINT AS l_linenumber, count(*) AS lines, count(*) AS in_place FROM lineitem GROUP BY 1",
    "q_lines_encoded": "SELECT doc_id, md5(text) AS digest FROM documents",
    "q_error_xml": """SELECT o_orderkey, 'xml' AS kind, '2026-01-01T00:00:00' AS stamp, 'App.' || o_orderstatus || 'Exception: order ' || o_orderkey AS head,
  least(o_orderkey % 30 + 1, 20) + 1 AS n_lines FROM orders WHERE o_orderkey % 7 <> 0""",
    "q_test_results": """SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) AS results,
  count(*) FILTER (o_orderstatus = 'F') AS failed_results, count(*) FILTER (o_orderstatus = 'F') AS messages FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1""",
    "q_catalog_json": """SELECT 'T' || c_custkey AS "table", 'A' AS "column", 'NUMBER(10)' AS type, CASE c_custkey % 3 WHEN 0 THEN true WHEN 2 THEN false END AS pk_flag,
  CASE WHEN c_custkey % 3 = 1 THEN 2 END::INTEGER AS pk_pos, CASE WHEN c_acctbal < 0 THEN true END AS pii, NULL::BOOLEAN AS safe FROM customer""",
    "q_history_parse": """SELECT c_custkey || '-' || i AS id, c_mktsegment AS solution, 2::BIGINT AS agents FROM customer, (VALUES (1), (2)) t(i) WHERE c_custkey % 3 <> 2""",
    "q_extract_controls": """WITH c AS (SELECT 'p' || page_id AS file, page_id AS line_no, 'L' || page_id % 50 AS id, 'label' AS label, 'rs-control' AS kind FROM pages
  UNION ALL SELECT 'p' || page_id, page_id, 'B' || page_id % 50, 'press', 'asp-control' FROM pages
  UNION ALL SELECT 'p' || page_id, page_id, 'T' || page_id % 50, 'turned', 'rs-control' FROM pages WHERE page_id % 4 = 0)
SELECT id, label, kind, file, line_no FROM (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY file, line_no, kind) AS r FROM c) WHERE r = 1""",
    "q_gate": """WITH f AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_nationkey % 3 = 0 THEN 'email' WHEN c_acctbal >= 0 THEN 'dni' END AS form FROM customer)
SELECT coalesce(form, 'passed') AS form, count(*) AS rows FROM f GROUP BY 1""",
    "q_mask_numeric_types": f"""SELECT c_custkey, {_pseudonym('AS_LONG', _PHONE)} AS as_long, {_pseudonym('AS_DOUBLE', _PHONE)} AS as_double,
  {_pseudonym('AS_DECIMAL', _PHONE)} AS as_decimal, {_pseudonym('AS_TEXT', _PHONE)} AS as_text, c_custkey + 600000000.25::DOUBLE AS amount FROM customer""",
    "q_guarded_quoted_names": f"""SELECT c_custkey, {_pseudonym('C_NATIONKEY', 'c_nationkey')} AS c_nationkey, {_pseudonym('C_NAME', 'c_name')} AS c_name,
  {_pseudonym('TAG', "'x -- y'")} AS tag, {_pseudonym('QUOTED', "'it''s'")} AS quoted FROM customer""",
    "q_guarded_renamed": f"""WITH u AS (SELECT s_suppkey AS id, s_nationkey AS x FROM supplier UNION ALL SELECT c_custkey, c_nationkey FROM customer),
g AS (SELECT id % 50 AS part, min(x) AS low, sum(x)::BIGINT AS total, count(x) AS n, count(DISTINCT x) AS kinds, max(id) AS highest, max(CASE WHEN x > 12 THEN 1 ELSE 0 END) AS high,
  (SELECT max(c_nationkey) FROM customer) AS top FROM u GROUP BY 1)
SELECT part, {_pseudonym('S_SUPPKEY', 'CAST(low AS VARCHAR)')} AS s_suppkey, {_pseudonym('TOTAL', 'CAST(total AS VARCHAR)')} AS total, n, kinds, highest,
  {_pseudonym('HIGH', 'CAST(high AS VARCHAR)')} AS high, {_pseudonym('TOP', 'CAST(top AS VARCHAR)')} AS top, 's_suppkey,total,high,top' AS masked, 'CUSTOMER,SUPPLIER' AS tables FROM g""",
    "q_guarded_capped": f"""SELECT c_custkey, {_pseudonym('C_NAME', 'c_name')} AS c_name, least(100, (SELECT count(*) FROM customer)) AS row_count,
  (SELECT count(*) > 100 FROM customer) AS rows_truncated FROM customer ORDER BY c_custkey LIMIT 100""",
    "q_numeric_precision": """WITH p AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::VARCHAR AS price FROM orders),
t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN split_part(price, '.', 1) WHEN o_orderkey % 5 = 0 THEN substr(price, 1, length(price) - 1) ELSE price END AS price FROM p)
SELECT o_orderkey AS line_no, 'price' AS field, 'numeric' AS rule, price AS value FROM t WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR length(price) > 8""",
    "q_layers": """SELECT CASE WHEN p_size % 5 = 0 THEN 'data access' WHEN p_partkey % 7 = 0 THEN 'business' WHEN p_size % 5 = 1 THEN 'presentation'
  WHEN p_size % 5 = 2 THEN 'infrastructure' WHEN p_size % 5 = 3 THEN 'testing' ELSE 'unclassified' END AS layer, count(*) AS projects FROM part GROUP BY 1""",
    # A customer's phrase is in a line exactly when the keys are equal, as both are set off by the same words.
    "q_phrase_repeats_whole": """WITH l AS (SELECT CASE WHEN o_orderkey % 4 <> 0 THEN 'f' END AS file, o_orderkey % 3 AS line_no, o_custkey FROM orders),
n AS (SELECT DISTINCT 'customer' || lpad(n_nationkey::VARCHAR, 4, '1') AS phrase FROM nation),
m AS (SELECT file, line_no, 'about customer' || c_custkey || ' and' AS phrase FROM l JOIN (SELECT DISTINCT c_custkey FROM customer) ON c_custkey = o_custkey
  UNION ALL SELECT file, line_no, phrase FROM l JOIN n ON contains('note about customer' || o_custkey || ' and their order ', phrase))
SELECT file, line_no, phrase, count(*) AS rows FROM m GROUP BY ALL""",
}
