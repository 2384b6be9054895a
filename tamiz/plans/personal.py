"""Registered queries: guarded SQL and personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.functions import personal as P
from tamiz.functions import sqltext as S
from tamiz.functions.fixed_values import CONTROL_LETTERS
from tamiz.operators import guard
from tamiz.operators import personal as O
from tamiz.plans.base import DEMO_KEY, LINES_SQL, TABLES, catalog_of, document_lines, documents, hmac_sql
from tamiz.session import table

POLICY = O.Policy.build("enforce", parametric=["NATION", "REGION"])

TOTALS = """
SELECT c.c_name, n.n_name, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY c.c_name, n.n_name"""

# One statement per order, as an expression both SQL dialects read the same way.
STATEMENT = """CASE
  WHEN o_orderpriority = '1-URGENT' THEN 'SELECT c.c_name FROM CUSTOMER c, ORDERS AS o WHERE o.o_custkey = c.c_custkey AND c.c_custkey = ' || CAST(o_custkey AS VARCHAR(20))
  WHEN o_orderpriority = '2-HIGH' THEN 'SELECT COUNT(*) FROM app.CUSTOMER WHERE C_NAME LIKE ' || chr(39) || 'Cust%' || chr(39) || ' -- by name; ' || CAST(o_custkey AS VARCHAR(20))
  WHEN o_orderpriority = '3-MEDIUM' THEN 'WITH x AS (SELECT * FROM ORDERS) DELETE FROM ORDERS WHERE O_ORDERKEY = ' || CAST(o_orderkey AS VARCHAR(20))
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'SELECT * FROM ORDERS o JOIN CUSTOMER AS c ON o.o_custkey = c.c_custkey /* ; */ WHERE UPPER(o.o_orderstatus) = ' || chr(39) || 'F' || chr(39) || ' ORDER BY o.o_orderdate, o.o_totalprice'
  WHEN o_orderstatus = 'F' THEN 'SELECT 1 FROM DUAL; DROP TABLE ORDERS'
  WHEN o_orderstatus = 'O' THEN 'select ' || chr(39) || 'it; is -- data' || chr(39) || ' from DUAL;'
  ELSE 'UPDATE ORDERS SET O_ORDERSTATUS = ' || chr(39) || 'P' || chr(39) || ' WHERE O_ORDERKEY = ' || CAST(o_orderkey AS VARCHAR(20)) END"""


def statements(spark, folder):
    expr = STATEMENT.replace("VARCHAR(20)", "STRING")
    orders = table(spark, folder, "orders")
    return orders.select("o_orderkey", "o_orderpriority", F.expr(expr).alias("sql"))


def guarded_customer_totals(spark, folder):
    for name in ("customer", "orders", "nation"):
        table(spark, folder, name).createOrReplaceTempView(name)
    catalog = catalog_of(spark, folder, ["customer", "orders", "nation", "region"])
    return guard.guarded_query(spark, TOTALS, catalog, POLICY, DEMO_KEY, max_rows=None)[0]


def pseudonym_join(spark, folder):
    catalog = catalog_of(spark, folder, ["customer"])
    customer = table(spark, folder, "customer")
    a, _ = O.mask(customer.select("c_name", "c_nationkey"), ["CUSTOMER"], catalog, POLICY, DEMO_KEY)
    b, _ = O.mask(customer.select("c_name", "c_mktsegment"), ["CUSTOMER"],
                  catalog.withColumn("safe", F.when(F.col("column") == "C_MKTSEGMENT", True)), POLICY, DEMO_KEY)
    both = O.correlate(a, b, "c_name", DEMO_KEY, DEMO_KEY)
    return both.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("customers"))


def customer_pseudonyms(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", P.pseudonym(F.col("c_name"), "customer", DEMO_KEY).alias("pseudonym"))


def detect_forms(spark, folder):
    words = documents(spark, folder).select(
        "lang", F.explode(F.split("text", r"[ \n\t\r]+")).alias("word"))
    shaped = words.withColumn("form", P.detect_form(F.col("word"))).where("form IS NOT NULL")
    return shaped.groupBy("lang", "form").agg(F.count("*").alias("words"))


def scan_columns(spark, folder):
    phone = F.concat(F.lit("6"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    sheet = table(spark, folder, "customer").select(
        "c_name", "c_acctbal", "c_mktsegment", phone.alias("phone"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("number"))
    return O.scan_columns(sheet, sheet.columns).select("column", "form", "hits", "non_blank")


def document_personal_counts(spark, folder):
    return O.personal_totals(documents(spark, folder), "text", ["lang", "source"])


def redact_documents(spark, folder):
    return documents(spark, folder).select("doc_id", F.md5(P.redact_text(F.col("text"))).alias("digest"))


DERIVED_ID = f"""lpad(CAST(c_custkey AS VARCHAR(20)), 8, '0') ||
  substr('{CONTROL_LETTERS}', CAST((c_custkey + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) % 23 + 1 AS INTEGER), 1)"""


def control_letters(spark, folder):
    ident = F.expr(DERIVED_ID.replace("VARCHAR(20)", "STRING"))
    noted = F.concat(F.lit("cliente "), ident, F.lit(" activo"))
    return table(spark, folder, "customer").select(
        "c_custkey", P.control_letter_ok(ident).alias("valid"), P.redact_text(noted).alias("note"))


def column_inventory(spark, folder):
    names = ["customer", "orders", "supplier", "part", "nation", "region"]
    catalog = catalog_of(spark, folder, names)
    samples = None
    for name in names:
        df = table(spark, folder, name)
        cells = F.array(*[F.struct(F.lit(c).alias("column"), P.as_text(F.col(c), t).alias("value"))
                          for c, t in df.dtypes])
        part = df.select(F.lit(name).alias("table"), F.inline(cells))
        samples = part if samples is None else samples.unionByName(part)
    inv = O.column_inventory(catalog, POLICY, samples)
    return inv.select("table", "column", "verdict", "reason", "suspect")


INVENTORY_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{c}', '{v}', '{r}', false)" for t, c, v, r in [
        ("CUSTOMER", "C_CUSTKEY", "clear", "type"), ("CUSTOMER", "C_NAME", "mask", "text"),
        ("CUSTOMER", "C_NATIONKEY", "clear", "type"), ("CUSTOMER", "C_ACCTBAL", "clear", "type"),
        ("CUSTOMER", "C_MKTSEGMENT", "mask", "text"),
        ("ORDERS", "O_ORDERKEY", "clear", "type"), ("ORDERS", "O_CUSTKEY", "clear", "type"),
        ("ORDERS", "O_ORDERSTATUS", "mask", "text"), ("ORDERS", "O_TOTALPRICE", "clear", "type"),
        ("ORDERS", "O_ORDERDATE", "clear", "type"), ("ORDERS", "O_ORDERPRIORITY", "mask", "text"),
        ("SUPPLIER", "S_SUPPKEY", "clear", "type"), ("SUPPLIER", "S_NAME", "mask", "text"),
        ("SUPPLIER", "S_NATIONKEY", "clear", "type"), ("SUPPLIER", "S_ACCTBAL", "clear", "type"),
        ("PART", "P_PARTKEY", "clear", "type"), ("PART", "P_NAME", "mask", "text"),
        ("PART", "P_BRAND", "mask", "text"), ("PART", "P_TYPE", "mask", "text"),
        ("PART", "P_SIZE", "clear", "type"), ("PART", "P_RETAILPRICE", "clear", "type"),
        ("NATION", "N_NATIONKEY", "clear", "parametric"), ("NATION", "N_NAME", "clear", "parametric"),
        ("NATION", "N_REGIONKEY", "clear", "parametric"),
        ("REGION", "R_REGIONKEY", "clear", "parametric"), ("REGION", "R_NAME", "clear", "parametric"),
    ]) + ') AS v("table", "column", verdict, reason, suspect)'


def unresolved_numbers(spark, folder):
    item = table(spark, folder, "lineitem")
    sheet = item.select(
        (F.col("l_orderkey") + 100000000).cast("string").alias("contract"), "l_quantity", "l_returnflag",
        F.col("l_partkey").cast("string").alias("part"), F.lit(" ").alias("nothing"))
    return O.resolve_unresolved(O.scan_columns(sheet, sheet.columns)).drop("form")


def leak_lines(spark, folder):
    phrases = table(spark, folder, "benchmark").select(F.explode(F.split("text", "\n")).alias("phrase"))
    phrases = phrases.select(P.strip(F.col("phrase")).alias("phrase"))
    found = O.leak_rules(document_lines(spark, folder), phrases)
    return found.select("file", "line_no", "reason", F.md5("fragment").alias("fragment"))


PAGE_RULES = [
    ("INLINE_SCRIPT", "critical", r"(?i)<script[^>]*>", [".html"], False),
    ("TRACKING", "high", r"track\(", [".html"], False),
    ("ABSOLUTE_LINK", "medium", r"(?i)href=.https?://", [".html"], False),
    ("WEB_ONLY_STYLE", "low", r"(?i)<style", [".html"], True),
    ("OTHER_FILES", "low", r"a", [".cs"], False),
]


def page_lines(spark, folder):
    split = table(spark, folder, "pages").select(
        F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("file"),
        F.posexplode(F.split("html", "\n")).alias("pos", "text"))
    return split.select("file", (F.col("pos") + 1).cast("bigint").alias("line_no"), "text")


def rule_findings(spark, folder):
    return O.rule_scan(page_lines(spark, folder), PAGE_RULES).select("file", "line_no", "id", "severity")


def severity_totals(spark, folder):
    return O.severity_counts(O.rule_scan(page_lines(spark, folder), PAGE_RULES))


PAGE_LINES_SQL = """lines AS (SELECT 'page' || page_id || '.html' AS file, unnest(parts) AS text,
  unnest(range(1, len(parts) + 1)) AS line_no FROM (SELECT page_id, string_split(html, chr(10)) AS parts FROM pages))"""
FINDINGS_SQL = f"""WITH {PAGE_LINES_SQL}, found AS (
  SELECT file, line_no, 'INLINE_SCRIPT' AS id, 'critical' AS severity FROM lines WHERE regexp_matches(text, '(?i)<script[^>]*>')
  UNION ALL SELECT file, line_no, 'TRACKING', 'high' FROM lines WHERE contains(text, 'track(')
  UNION ALL SELECT file, line_no, 'ABSOLUTE_LINK', 'medium' FROM lines WHERE regexp_matches(text, '(?i)href=.https?://')
  UNION ALL SELECT file, line_no, 'WEB_ONLY_STYLE', 'low' FROM lines WHERE regexp_matches(text, '(?i)<style'))
"""


def classify_statements(spark, folder):
    return guard.classify_sql(statements(spark, folder)).select("o_orderkey", "readonly", "reason")


def sql_scope(spark, folder):
    sql = F.col("sql")
    return statements(spark, folder).select(
        "o_orderkey", F.array_join(S.sql_tables(sql), ",").alias("tables"),
        F.array_join(S.sql_predicates(sql), ",").alias("filtered"), S.blank_literals(sql).alias("shown"))


def predicate_leak(spark, folder):
    """Statements that filter on a column the policy masks."""
    catalog = catalog_of(spark, folder, ["customer", "orders"])
    sql = F.col("sql")
    wanted = (statements(spark, folder)
              .select("o_orderkey", S.sql_tables(sql).alias("ts"), F.explode(S.sql_predicates(sql)).alias("column"))
              .select("o_orderkey", "column", F.explode_outer("ts").alias("table")))
    judged = O.classify_columns(wanted, catalog, POLICY, ["o_orderkey"])
    return judged.where(F.col("verdict") == O.MASK).select("o_orderkey", "column", "reason")


def workspace_modes(spark, folder):
    orders = table(spark, folder, "orders")
    mode = (F.when(F.col("o_orderpriority") == "1-URGENT", "enforce").when(F.col("o_orderpriority") == "2-HIGH", "audit")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "off"))
    modes = orders.select(F.col("o_custkey").alias("workspace"), mode.alias("mode"),
                          (F.col("o_totalprice") > 480000).alias("declared"))
    return O.strictest_mode(modes)


QUERIES = {
    "q_guarded_customer_totals": guarded_customer_totals,
    "q_pseudonym_join": pseudonym_join,
    "q_customer_pseudonyms": customer_pseudonyms,
    "q_detect_forms": detect_forms,
    "q_scan_columns": scan_columns,
    "q_document_personal_counts": document_personal_counts,
    "q_redact_documents": redact_documents,
    "q_dni_check": control_letters,
    "q_column_inventory": column_inventory,
    "q_unresolved_numbers": unresolved_numbers,
    "q_leak_rules": leak_lines,
    "q_rule_scan": rule_findings,
    "q_severity_counts": severity_totals,
    "q_classify_sql": classify_statements,
    "q_sql_scope": sql_scope,
    "q_predicate_leak": predicate_leak,
    "q_strictest_mode": workspace_modes,
}

_IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"
_MAIL = r"\b[^@\s]+@[^@\s]+\.[A-Za-z]{2,}\b"
_NAME = hmac_sql("'C_NAME|' || c.c_name", DEMO_KEY)
ORACLE = {
    "q_guarded_customer_totals": f"""
SELECT 'pii:' || substr({_NAME}, 1, 12) AS c_name, n.n_name,
       CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY c.c_name, n.n_name""",
    "q_pseudonym_join": """SELECT a.c_nationkey, b.c_mktsegment, count(*) AS customers
FROM customer a JOIN customer b ON a.c_name = b.c_name GROUP BY ALL""",
    "q_customer_pseudonyms": "SELECT c_custkey, 'pii:' || substr("
                             + hmac_sql("'CUSTOMER|' || c_name", DEMO_KEY) + ", 1, 12) AS pseudonym FROM customer",
    "q_detect_forms": r"""SELECT lang, form, count(*) AS words FROM (SELECT lang, CASE
  WHEN regexp_full_match(word, '(?i)\d{8}[A-HJ-NP-TV-Z]') THEN 'dni'
  WHEN regexp_full_match(word, '(?i)[XYZ]\d{7}[A-HJ-NP-TV-Z]') THEN 'nie'
  WHEN regexp_full_match(word, '(?i)[A-Z]{2}\d{2}[A-Z0-9]{10,30}') THEN 'iban'
  WHEN regexp_full_match(word, '[^@\s]+@[^@\s]+\.[A-Za-z]{2,}') THEN 'email'
  WHEN regexp_full_match(word, '(?:\+34)?[6789]\d{8}') THEN 'telefono'
  WHEN regexp_full_match(word, '\d{13,19}') THEN 'tarjeta'
  WHEN regexp_full_match(word, '\d{8}') THEN 'dni_num' END AS form
FROM (SELECT lang, unnest(string_split_regex(text, '[ \n\t\r]+')) AS word FROM documents))
WHERE form IS NOT NULL GROUP BY ALL""",
    "q_scan_columns": """SELECT * FROM (
  SELECT 'c_name' AS "column", NULL::VARCHAR AS form, 0::BIGINT AS hits, count(*) AS non_blank FROM customer
  UNION ALL SELECT 'c_acctbal', NULL, 0, count(*) FROM customer
  UNION ALL SELECT 'c_mktsegment', NULL, 0, count(*) FROM customer
  UNION ALL SELECT 'phone', 'telefono', count(*), count(*) FROM customer
  UNION ALL SELECT 'number', 'dni_num', count(*), count(*) FROM customer)""",
    "q_document_personal_counts": rf"""SELECT lang, source,
  sum(len(list_filter(regexp_extract_all(text, '\b\d{{8}}[A-HJ-NP-TV-Z]\b'), lambda x:
    substr('TRWAGMYFPDXBNJZSQVHLCKE', substr(x, 1, 8)::INT % 23 + 1, 1) = substr(x, 9, 1))))::BIGINT AS dni,
  sum(len(list_filter(regexp_extract_all(text, '\b[XYZ]\d{{7}}[A-HJ-NP-TV-Z]\b'), lambda x:
    substr('TRWAGMYFPDXBNJZSQVHLCKE', translate(substr(x, 1, 8), 'XYZ', '012')::INT % 23 + 1, 1) = substr(x, 9, 1))))::BIGINT AS nie,
  sum(len(regexp_extract_all(text, '{_IBAN}')))::BIGINT AS iban,
  sum(len(regexp_extract_all(text, '{_MAIL}')))::BIGINT AS email
FROM documents GROUP BY ALL""",
    "q_redact_documents": f"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{_IBAN}', '[PII]', 'g'),
  '{_MAIL}', '[PII]', 'g')) AS digest FROM documents""",
    "q_dni_check": f"""SELECT c_custkey, c_acctbal >= 0 AS valid,
  'cliente ' || CASE WHEN c_acctbal >= 0 THEN '[PII]' ELSE {DERIVED_ID} END || ' activo' AS note FROM customer""",
    "q_column_inventory": INVENTORY_SQL,
    "q_unresolved_numbers": """SELECT * FROM (VALUES ('contract', 'mask', 'other values'), ('l_quantity', 'clear', 'plain numbers'),
  ('l_returnflag', 'mask', 'other values'), ('part', 'clear', 'plain numbers'), ('nothing', 'mask', 'blank'))
  AS v("column", verdict, reason) WHERE (SELECT count(*) FROM lineitem) > 0""",
    "q_leak_rules": rf"""WITH {LINES_SQL},
phrases AS (SELECT DISTINCT trim(p) AS phrase FROM (SELECT unnest(string_split(text, chr(10))) AS p FROM benchmark)
  WHERE length(trim(p)) >= 12),
found AS (
  SELECT file, line_no, 'personal-data mark' AS reason, text FROM lines WHERE regexp_matches(text, '(?i)"(pii|safe|clasificacion|clasificación)"\s*:')
  UNION ALL SELECT file, line_no, 'personal-data mark', text FROM lines WHERE regexp_matches(text, '(?i)\bpii\s*[:=]\s*(true|false|"|'')')
  UNION ALL SELECT file, line_no, 'description field', text FROM lines WHERE regexp_matches(text, '(?i)"description"\s*:')
  UNION ALL SELECT file, line_no, 'internal ticket', text FROM lines WHERE regexp_matches(text, '{O.V.LEAK_PATTERNS[3][1]}')
    AND NOT regexp_matches(regexp_extract(text, '{O.V.LEAK_PATTERNS[3][1]}'), '{O.V.NOT_A_TICKET}')
  UNION ALL SELECT file, line_no, 'developer path', text FROM lines WHERE regexp_matches(text, '{O.V.LEAK_PATTERNS[4][1]}')
  UNION ALL SELECT file, line_no, 'literal description', text FROM lines JOIN phrases ON contains(text, phrase))
SELECT file, line_no, reason, md5(substr(trim(text), 1, 120)) AS fragment FROM found""",
    "q_rule_scan": FINDINGS_SQL + "SELECT file, line_no, id, severity FROM found",
    "q_severity_counts": FINDINGS_SQL + "SELECT severity, count(*) AS findings FROM found GROUP BY severity",
    "q_classify_sql": f"""SELECT o_orderkey, reason IS NULL AS readonly, reason FROM (SELECT o_orderkey, CASE
  WHEN o_orderpriority = '3-MEDIUM' THEN '{S.WRITE_IN_CTE}'
  WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN '{S.MULTI_STATEMENT}'
  WHEN o_orderpriority = '5-LOW' AND o_orderstatus <> 'O' THEN '{S.ONLY_SELECT}' END AS reason FROM orders)""",
    "q_sql_scope": f"""SELECT o_orderkey,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'CUSTOMER,ORDERS' WHEN o_orderpriority = '2-HIGH' THEN 'CUSTOMER'
    WHEN o_orderpriority = '3-MEDIUM' THEN 'ORDERS' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'ORDERS,CUSTOMER'
    ELSE '' END AS tables,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'O_CUSTKEY,C_CUSTKEY' WHEN o_orderpriority = '2-HIGH' THEN 'C_NAME'
    WHEN o_orderpriority = '3-MEDIUM' THEN 'O_ORDERKEY' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ''
    WHEN o_orderstatus IN ('F', 'O') THEN '' ELSE 'O_ORDERKEY' END AS filtered,
  regexp_replace({STATEMENT}, '''[^'']*''', '''?''', 'g') AS shown FROM orders""",
    "q_predicate_leak": """SELECT o_orderkey, 'C_NAME' AS "column", 'text' AS reason FROM orders WHERE o_orderpriority = '2-HIGH'""",
    "q_strictest_mode": """SELECT workspace, ['off', 'audit', 'enforce', 'indeterminate'][max(rank) + 1] AS mode, max(rank) >= 1 AS active
FROM (SELECT o_custkey AS workspace, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 WHEN o_orderpriority = '2-HIGH' THEN 1
  WHEN o_orderpriority = '3-MEDIUM' THEN 0 WHEN o_totalprice > 480000 THEN 3 ELSE 0 END AS rank FROM orders) GROUP BY workspace""",
}
