"""Registered queries: input-file validation over text made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.operators import validate as O
from tamiz.session import local_rows, table

Field, Structure = O.Field, O.Structure


def _text(c):
    return F.col(c).cast("string")


def order_rows(spark, folder):
    """Orders as rows of yearly text files."""
    price = F.replace(F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))
    day = (F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "dd/MM/yyyy"))
           .when(F.col("o_orderpriority") == "5-LOW",
                 F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lpad((F.dayofmonth("o_orderdate") + 9).cast("string"), 2, "0")))
           .otherwise(F.date_format("o_orderdate", "yyyyMMdd")))
    return table(spark, folder, "orders").select(
        F.concat(F.lit("orders_"), F.year("o_orderdate").cast("string")).alias("file"),
        (F.col("o_orderkey") + 1).alias("line_no"), _text("o_orderkey").alias("id"), _text("o_custkey").alias("cust"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("").alias("status"),
        price.alias("price"), F.col("o_orderpriority").alias("priority"), day.alias("day"))


ORDERS = Structure(
    "ORDERS", numeric_format=",", fields=(
        Field("id", "integer", pk=True, nullable=False), Field("cust", "integer", max=1000),
        Field("status", nullable=False, domain=("F", "X")), Field("price", "decimal", decimales=2, min=2000, max=400000),
        Field("priority", longitud=8), Field("day", "date")),
    unique_combos=(("cust", "status", "priority"),))


def validate_fields(spark, folder):
    spec = Structure("ORDERS", numeric_format=",", fields=ORDERS.fields[:5])
    return O.check_rows(order_rows(spark, folder), spec)


def validate_dates(spark, folder):
    return O.check_rows(order_rows(spark, folder), Structure("ORDERS", fields=(Field("day", "date"),)))


def compare_fields(spark, folder):
    spec = Structure("ITEMS", fields=(Field("discount", "decimal", decimales=2), Field("tax", "decimal", decimales=2),
                                      Field("quantity", "decimal", decimales=1), Field("line", "integer")),
                     comparisons=(("discount", ">=", "tax"), ("quantity", "!=", "line")))
    rows = table(spark, folder, "lineitem").select(
        F.lit("items").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"),
        F.col("l_discount").cast("decimal(5,2)").cast("string").alias("discount"),
        F.col("l_tax").cast("decimal(5,2)").cast("string").alias("tax"),
        F.col("l_quantity").cast("decimal(5,1)").cast("string").alias("quantity"), _text("l_linenumber").alias("line"))
    return O.check_rows(rows, spec).select("line_no", "field", "rule", "value", "message")


def _order_keys(spark, folder):
    return table(spark, folder, "orders").select(
        F.lit("orders").alias("file"), F.col("o_orderkey").alias("line_no"), _text("o_custkey").alias("cust"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"))


def pk_duplicates(spark, folder):
    return O.check_pk(_order_keys(spark, folder), ["cust", "month"])


def unique_combos(spark, folder):
    return O.check_unique_combos(_order_keys(spark, folder), [["cust", "status", "priority"], ["month", "priority"]])


def check_catalog(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("file"), F.col("l_orderkey").alias("line_no"), "l_suppkey")
    known = table(spark, folder, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("code"))
    return O.check_catalog(rows, "l_suppkey", known).groupBy("file", "value").agg(F.count("*").alias("rows"))


def relation_both_ways(spark, folder):
    f1 = table(spark, folder, "customer").where("c_acctbal > 0").select(
        F.lit("customers").alias("file"), F.col("c_custkey").alias("line_no"), F.col("c_custkey").alias("cust"))
    f2 = table(spark, folder, "orders").where("o_totalprice > 400000").select(
        F.lit("orders").alias("file"), F.col("o_orderkey").alias("line_no"), F.col("o_custkey").alias("owner"))
    return O.check_relation(f1, f2, [("cust", "owner")])


NAMES = [("GENERAL", "example", True), ("COM", "example.com", True), ("BLOG", "blog.", False),
         ("BLOG_COM", "example.com/en", False), ("FTP", "ftp://", True), ("PAGED", "?page=", False)]


def _matched(spark, folder):
    rules = local_rows(spark, NAMES, "structure string, pattern string, required boolean")
    return O.match_files(table(spark, folder, "pages").select(F.col("url").alias("file")), rules), rules


def match_files(spark, folder):
    return _matched(spark, folder)[0]


def missing_files(spark, folder):
    matched, rules = _matched(spark, folder)
    gone = O.missing_files(matched, rules).select(F.lit("missing").alias("problem"), F.col("structure").alias("name"))
    return gone.unionByName(O.unmatched_files(matched).select(F.lit("unmatched").alias("problem"), F.col("file").alias("name")))


def validation_report(spark, folder):
    rows = order_rows(spark, folder)
    return O.validation_report(O.check_structure(rows, ORDERS), rows)


def detect_structure(spark, folder):
    parts = [_text("o_orderkey"), _text("o_custkey"), F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderpriority"),
             F.col("o_totalprice").cast("decimal(12,2)").cast("string")]
    status = F.col("o_orderstatus")
    text = F.when(status == "F", F.concat_ws(";", *parts)).when(status == "O", F.concat_ws("|", *parts)).otherwise(
        F.concat_ws("\t", *parts))
    sample = table(spark, folder, "orders").select(status.alias("file"), F.col("o_orderkey").alias("line_no"), text.alias("text"))
    out = O.detect_structure(sample)
    return out.select("file", F.ascii("separator").cast("int").alias("separator"), "columns",
                      F.col("position").cast("int").alias("position"), "type")


def _versions(spark, folder):
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("structure"), F.col("turn").alias("version"), F.md5("text").alias("body"))


def structure_versions(spark, folder):
    return O.latest_version(_versions(spark, folder))


def restore_versions(spark, folder):
    return O.restore_version(_versions(spark, folder), 1)


def group_filter(spark, folder):
    parts = table(spark, folder, "part").select("p_brand", (F.col("p_size") % 5).alias("group_id"))
    out = O.group_filter(parts, 0).withColumn("grp", F.lit("standard")).unionByName(
        O.group_filter(parts, 3).withColumn("grp", F.lit("custom")))
    return out.groupBy("p_brand", "grp").agg(F.count("*").alias("structures"))


def user_pairs(spark, folder):
    relations = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("user_tenant"), F.col("l_partkey").alias("file"))
    files = table(spark, folder, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("owner"))
    return O.expand_user_pairs(relations, files).groupBy("user_tenant").agg(
        F.count("*").alias("files"), F.count_distinct("owner").alias("owners"))


def propagate_order(spark, folder):
    attributes = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("species"), F.col("l_linenumber").alias("table_order"))
    species = table(spark, folder, "part").select(
        F.col("p_partkey").alias("species"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("process_order"))
    return O.propagate_order(attributes, species).groupBy("species").agg(F.sum("table_order").alias("order_sum"))


def orphan_rows(spark, folder):
    attributes = table(spark, folder, "orders").select(F.col("o_custkey").alias("file"), "o_orderstatus")
    files = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("file"))
    return O.orphan_rows(attributes, files).groupBy("o_orderstatus", "orphan").agg(F.count("*").alias("rows"))


def orphan_references(spark, folder):
    tenants = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("code"))
    codes = table(spark, folder, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("code"))
    return O.orphan_references(tenants, codes)


QUERIES = {
    "q_validate_fields": validate_fields, "q_validate_dates": validate_dates, "q_compare_fields": compare_fields,
    "q_pk_duplicates": pk_duplicates, "q_unique_combos": unique_combos, "q_check_catalog": check_catalog,
    "q_relation_both_ways": relation_both_ways, "q_match_files": match_files, "q_missing_files": missing_files,
    "q_validation_report": validation_report, "q_detect_structure": detect_structure,
    "q_structure_versions": structure_versions, "q_restore_versions": restore_versions, "q_group_filter": group_filter,
    "q_user_pairs": user_pairs, "q_propagate_order": propagate_order, "q_orphan_rows": orphan_rows,
    "q_orphan_references": orphan_references,
}

_ROWS = """rows AS (SELECT 'orders_' || year(o_orderdate) AS file, o_orderkey + 1 AS line_no, o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS cust,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE '' END AS status, replace(o_totalprice::DECIMAL(12,2)::VARCHAR, '.', ',') AS price,
  o_orderpriority AS priority, CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%d/%m/%Y')
    WHEN o_orderpriority = '5-LOW' THEN strftime(o_orderdate, '%Y%m') || lpad((day(o_orderdate) + 9)::VARCHAR, 2, '0')
    ELSE strftime(o_orderdate, '%Y%m%d') END AS day FROM orders)"""
_FOUND = """f AS (
  SELECT file, line_no, 'cust' AS field, 'max' AS rule, cust AS value, 'above 1000' AS message FROM rows WHERE cust::BIGINT > 1000
  UNION ALL SELECT file, line_no, 'status', 'required', status, 'value is required' FROM rows WHERE status = ''
  UNION ALL SELECT file, line_no, 'status', 'domain', status, 'value not allowed' FROM rows WHERE status NOT IN ('', 'F', 'X')
  UNION ALL SELECT file, line_no, 'price', 'min', price, 'below 2000' FROM rows WHERE replace(price, ',', '.')::DECIMAL(12,2) < 2000
  UNION ALL SELECT file, line_no, 'price', 'max', price, 'above 400000' FROM rows WHERE replace(price, ',', '.')::DECIMAL(12,2) > 400000
  UNION ALL SELECT file, line_no, 'priority', 'length', priority, 'longer than 8' FROM rows WHERE length(priority) > 8)"""
_DATES = """d AS (SELECT file, line_no, 'day' AS field, 'date' AS rule, day AS value, 'not a date AAAAMMDD' AS message FROM rows
  WHERE NOT regexp_full_match(day, '\\d{8}') OR try_strptime(day, '%Y%m%d') IS NULL)"""


def _dups(source: str, cols: list[str], field: str, rule: str) -> str:
    key = " || '|' || ".join(cols)
    return (f"SELECT file, line_no, '{field}' AS field, '{rule}' AS rule, {key} AS value, 'repeated' AS message FROM (SELECT *, "
            f"row_number() OVER (PARTITION BY file, {', '.join(cols)} ORDER BY line_no) AS rn FROM {source}) WHERE rn > 1")


_KEYS = """k AS (SELECT 'orders' AS file, o_orderkey AS line_no, o_custkey::VARCHAR AS cust, strftime(o_orderdate, '%Y-%m') AS month,
  o_orderstatus AS status, o_orderpriority AS priority FROM orders)"""
_MATCH = """m AS (SELECT url AS file, CASE WHEN contains(upper(url), 'EXAMPLE.COM/EN') THEN 'BLOG_COM' WHEN contains(upper(url), 'EXAMPLE.COM') THEN 'COM'
  WHEN contains(upper(url), 'EXAMPLE') THEN 'GENERAL' WHEN contains(upper(url), '?PAGE=') THEN 'PAGED' WHEN contains(upper(url), 'FTP://') THEN 'FTP'
  WHEN contains(upper(url), 'BLOG.') THEN 'BLOG' END AS structure FROM pages)"""
_TYPES = "(VALUES (0, 'integer'), (1, 'integer'), (2, 'date AAAAMMDD'), (3, 'text'), (4, 'decimal')) AS t(position, type)"

ORACLE = {
    "q_validate_fields": f"WITH {_ROWS}, {_FOUND} SELECT * FROM f",
    "q_validate_dates": f"WITH {_ROWS}, {_DATES} SELECT * FROM d",
    "q_compare_fields": """SELECT l_orderkey * 10 + l_linenumber AS line_no, 'discount' AS field, 'comparison' AS rule, l_discount::DECIMAL(5,2)::VARCHAR AS value,
  'not >= tax' AS message FROM lineitem WHERE l_discount::DECIMAL(5,2) < l_tax::DECIMAL(5,2)
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'quantity', 'comparison', l_quantity::DECIMAL(5,1)::VARCHAR, 'not != line' FROM lineitem WHERE l_quantity = l_linenumber""",
    "q_pk_duplicates": f"WITH {_KEYS} " + _dups("k", ["cust", "month"], "cust,month", "pk"),
    "q_unique_combos": f"WITH {_KEYS} " + _dups("k", ["cust", "status", "priority"], "UNIQUE", "unique:cust,status,priority")
                       + " UNION ALL " + _dups("k", ["month", "priority"], "UNIQUE", "unique:month,priority"),
    "q_check_catalog": """SELECT l_returnflag AS file, l_suppkey::VARCHAR AS value, count(*) AS rows FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY ALL""",
    "q_relation_both_ways": """WITH a AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0), b AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 400000)
SELECT 'customers' AS file, c_custkey AS line_no, 'cust' AS field, 'f1_not_in_f2' AS rule, c_custkey::VARCHAR AS value, 'no matching row' AS message
FROM a WHERE c_custkey NOT IN (SELECT o_custkey FROM b)
UNION ALL SELECT 'orders', o_orderkey, 'owner', 'f2_not_in_f1', o_custkey::VARCHAR, 'no matching row' FROM b WHERE o_custkey NOT IN (SELECT c_custkey FROM a)""",
    "q_match_files": f"WITH {_MATCH} SELECT * FROM m",
    "q_missing_files": f"""WITH {_MATCH} SELECT 'missing' AS problem, name FROM (VALUES ('GENERAL'), ('COM'), ('FTP')) v(name) WHERE name NOT IN (SELECT structure FROM m WHERE structure IS NOT NULL)
UNION ALL SELECT 'unmatched', file FROM m WHERE structure IS NULL""",
    "q_validation_report": f"""WITH {_ROWS}, {_FOUND}, {_DATES}, u AS ({_dups('rows', ['cust', 'status', 'priority'], 'UNIQUE', 'unique:cust,status,priority')}),
a AS (SELECT * FROM f UNION ALL SELECT * FROM d UNION ALL SELECT * FROM u), n AS (SELECT file, count(*) AS rows FROM rows GROUP BY file)
SELECT a.file, a.field, a.rule, a.errors, coalesce(n.rows, (SELECT count(*) FROM rows)) - a.bad AS valid_rows, a.errors > 1000 AS over_cap
FROM (SELECT file, field, rule, count(*) AS errors, count(DISTINCT (file, line_no)) AS bad FROM a GROUP BY ROLLUP (file, field, rule)) a LEFT JOIN n ON n.file = a.file""",
    "q_detect_structure": f"""SELECT s.file, s.separator, 5 AS columns, t.position, t.type FROM (SELECT DISTINCT o_orderstatus AS file,
  CASE o_orderstatus WHEN 'F' THEN 59 WHEN 'O' THEN 124 ELSE 9 END AS separator FROM orders) s, {_TYPES}""",
    "q_structure_versions": "SELECT conv_id AS structure, max(turn) AS version, max_by(md5(text), turn) AS body FROM conversations GROUP BY conv_id",
    "q_restore_versions": """SELECT conv_id AS structure, turn AS version, md5(text) AS body FROM conversations
UNION ALL SELECT c.conv_id, m.n, md5(c.text) FROM conversations c JOIN (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id) m USING (conv_id) WHERE c.turn = 1""",
    "q_group_filter": """SELECT p_brand, CASE WHEN p_size % 5 = 0 THEN 'standard' ELSE 'custom' END AS grp, count(*) AS structures FROM part
WHERE p_size % 5 IN (0, 3) GROUP BY ALL""",
    "q_user_pairs": """SELECT l_suppkey AS user_tenant, count(DISTINCT l_partkey) AS files, count(DISTINCT p_size) AS owners
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    "q_propagate_order": """SELECT l_partkey AS species, sum(CASE WHEN p_size > 25 THEN p_size ELSE l_linenumber END)::BIGINT AS order_sum
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    "q_orphan_rows": """SELECT o_orderstatus, o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS orphan, count(*) AS rows FROM orders GROUP BY ALL""",
    "q_orphan_references": """SELECT c_custkey, c_nationkey AS code FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)""",
}
