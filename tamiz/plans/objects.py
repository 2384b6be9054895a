"""Registered queries: object snapshots, parsed text sources, exports and synthetic rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamiz.functions import bodies as B
from tamiz.functions import fixed_values as V
from tamiz.operators import history as H
from tamiz.operators import seed as G
from tamiz.operators import snapshot as O
from tamiz.operators.validate import Field, Structure
from tamiz.plans.base import documents
from tamiz.plans.history import runs
from tamiz.sources import sinks as Z
from tamiz.sources import text as A
from tamiz.session import durable, local_rows, shared_folder, table

SECTION = "CASE lang WHEN 'en' THEN 'procedimientos' WHEN 'fr' THEN 'vistas' WHEN 'de' THEN 'secuencias' ELSE 'triggers' END"
NAME = """CASE WHEN lang <> 'en' THEN 'D' || CAST(doc_id AS TXT) WHEN doc_id % 4 = 0 THEN 'PACKAGE P' || CAST(doc_id DIV 4 AS TXT)
  WHEN doc_id % 4 = 1 THEN 'PACKAGE BODY P' || CAST(doc_id DIV 4 AS TXT) ELSE 'PROCEDURE D' || CAST(doc_id AS TXT) END"""


def editions(spark, folder):
    """Two editions of the documents as objects: some added, removed, changed or disabled."""
    docs = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    base = docs.select(F.expr(SECTION).alias("section"), F.expr(NAME.replace("TXT", "STRING")).alias("name"),
                       F.col("text").alias("body"), "source", F.coalesce("quality", F.lit(0)).alias("quality"),
                       (F.coalesce("toxic", F.lit(0)) == 1).alias("disabled"))
    old = base.where("source <> 'src1'").select("section", "name", "body", F.lit(False).alias("disabled"))
    changed = F.when(F.col("quality") == 1, F.concat("body", F.lit("\nEND; -- v2"))).otherwise(F.concat("body", F.lit("  \r\n")))
    new = base.where("source <> 'src2'").select("section", "name", changed.alias("body"), "disabled")
    return old, new


def body_signature(spark, folder):
    text = F.col("text")
    return documents(spark, folder).select(
        "doc_id", B.body_signature(text).alias("signature"), B.line_count(text).cast("bigint").alias("lines"))


def _known(spark, folder):
    words = table(spark, folder, "benchmark").select(F.explode(F.split("text", r"[^\p{L}\p{N}_]+")).alias("table"))
    return words.where(F.length("table") >= 6)


def inventory(spark, folder):
    cards = O.build_inventory(editions(spark, folder)[1], _known(spark, folder))
    return cards.select("section", "name", "state", "signature", "line_count", F.size("used_tables").cast("bigint").alias("used"),
                        F.md5(F.array_join("used_tables", ",")).alias("used_digest"))


def users_by_section(spark, folder):
    return O.users_by_section(O.build_inventory(editions(spark, folder)[0], _known(spark, folder)))


def _diff(spark, folder):
    old, new = editions(spark, folder)
    return O.diff_inventory(O.build_inventory(old), O.build_inventory(new))


def inventory_diff(spark, folder):
    return _diff(spark, folder)


def delivery_plan(spark, folder):
    return O.plan_delivery(_diff(spark, folder))


def failed_sections(spark, folder):
    """Differences and cards when reading the French and English objects failed."""
    old, new = editions(spark, folder)
    errors = documents(spark, folder).where("lang IN ('fr', 'en')").select(F.expr(SECTION).alias("section")).distinct()
    before, after = O.build_inventory(old), O.build_inventory(new)
    left = O.drop_failed_sections(O.diff_inventory(before, after), errors).select(
        F.lit("change").alias("what"), "section", "name", F.col("change").alias("detail"))
    kept = O.carry_failed_sections(before, after, errors).select(
        F.lit("card").alias("what"), "section", "name", F.concat_ws(" ", "signature", F.col("carried").cast("string")).alias("detail"))
    return left.unionByName(kept)


def compare_trees(spark, folder):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    docs = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    a = docs.where("source <> 'src3'").select(path.alias("path"), F.col("text").alias("content"))
    b = docs.where("source <> 'src4'").select(path.alias("path"), F.when(F.col("toxic") == 1, F.concat("text", F.lit("!")))
                                              .otherwise(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("content"))
    return O.compare_trees(a, b)


def insert_sql(spark, folder):
    out = None
    for name in ("nation", "supplier", "orders"):
        part = Z.insert_statements(table(spark, folder, name), name.upper())
        out = part if out is None else out.unionByName(part)
    return out


def terminated_rows(spark, folder):
    d = V.COLUMN_DELIMITER
    customer = table(spark, folder, "customer")
    cells = [F.col("c_custkey").cast("string"), F.concat("c_name", F.lit(V.LF_TOKEN + "x")),
             F.when(F.col("c_acctbal") < 0, V.NULL_TOKEN).otherwise(F.col("c_mktsegment"))]
    odd = F.when(F.col("c_nationkey") == 3, d + "extra").otherwise("")
    records = customer.select(F.concat(F.lit("\n"), F.concat_ws(d, *cells), odd).alias("value"))
    rows, rejects = A.parse_terminated(records, ["key", "name", "segment"])
    return rows.unionByName(rejects.select(F.lit("rejected").alias("key"), F.col("cells").cast("string").alias("name"),
                                           F.md5("text").alias("segment")))


POSITIONAL = Structure("CUSTOMERS", file_type="positional", fields=(
    Field("key", "integer", longitud=10, start=1), Field("name", longitud=20, start=11), Field("segment", longitud=4, start=31)))
QUOTED = Structure("ORDERS", delimiter=";", text_qualifier='"', fields=(Field("key"), Field("note"), Field("priority")))


def structured_rows(spark, folder):
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    flat = customer.select(F.lit("c").alias("file"), F.col("c_custkey").alias("line_no"), F.concat(
        F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.rpad("c_name", 20, " "), "c_mktsegment").alias("text"))
    note = F.concat(F.lit('"a;b ""'), "o_orderstatus", F.lit('"""'))
    quoted = orders.select(F.lit("o").alias("file"), F.col("o_orderkey").alias("line_no"), F.concat_ws(
        ";", F.col("o_orderkey").cast("string"), note, F.col("o_orderpriority")).alias("text"))
    a = A.parse_structured(flat, POSITIONAL).select("file", "line_no", "key", F.col("name").alias("a"), F.col("segment").alias("b"))
    return a.unionByName(A.parse_structured(quoted, QUOTED).select("file", "line_no", "key", F.col("note").alias("a"), F.col("priority").alias("b")))


def _log(spark, folder):
    """One log of all orders: finished orders head a commit, every order adds a file line."""
    orders = table(spark, folder, "orders")
    head = orders.where("o_orderstatus = 'F'").select((F.col("o_orderkey") * 2).alias("line_no"), F.concat_ws(
        "\u001f", F.concat(F.lit("r"), F.col("o_orderkey").cast("string")), F.lit("ana"), F.lit("2026-01-01 10:00:00"), F.lit("cambio")).alias("text"))
    mark = F.when(F.col("o_orderpriority") == "1-URGENT", "A\t").when(F.col("o_orderpriority") == "2-HIGH", "R100\told\t").otherwise("M\t")
    line = orders.select((F.col("o_orderkey") * 2 + 1).alias("line_no"), F.concat(
        mark, F.lit("src/f"), F.col("o_custkey").cast("string")).alias("text"))
    return durable(head.unionByName(line).withColumn("file", F.lit("log")))


def commit_log(spark, folder):
    commits, files = A.parse_commit_log(_log(spark, folder))
    per = files.groupBy("revision").agg(F.count("*").alias("files"), F.count_if(F.col("action") == "R").alias("renamed"))
    return per.join(commits.select("revision", "author", "message"), "revision", "left")


def commit_paths(spark, folder):
    return H.last_action(A.parse_commit_log(_log(spark, folder))[1], "seq")


def parse_diff(spark, folder):
    orders = table(spark, folder, "orders")
    name = F.concat(F.lit("src/F"), F.col("o_custkey").cast("string"), F.lit(".cs"))
    head = orders.where("o_orderstatus = 'F'").select((F.col("o_orderkey") * 2).alias("line_no"), F.concat(
        F.lit("diff --git a/"), name, F.lit(" b/"), name).alias("text"))
    mark = F.when(F.col("o_orderpriority") == "1-URGENT", "+").when(F.col("o_orderpriority") == "2-HIGH", "-").when(
        F.col("o_orderpriority") == "3-MEDIUM", "+++ b/").otherwise(" ")
    line = orders.select((F.col("o_orderkey") * 2 + 1).alias("line_no"), F.concat(mark, F.lit("int x = 1;")).alias("text"))
    lines = durable(head.unionByName(line).withColumn("file", F.lit("all.diff")))
    return A.parse_diff(lines).groupBy("file").agg(F.count_if(F.col("sign") == "+").alias("added"),
                                                   F.count_if(F.col("sign") == "-").alias("removed"), F.count("*").alias("lines"))


CLIENTS = [G.SeedColumn("id", "bigint", unique=True, nullable=False), G.SeedColumn("nombre", "string", 14, nullable=False),
           G.SeedColumn("alta", "date"), G.SeedColumn("saldo", "int")]


def seed_rows(spark, folder):
    """A synthetic client for every customer."""
    return G.seed_like(table(spark, folder, "customer"), "c_custkey", CLIENTS).withColumns({c: F.col(c).cast("string") for c in ("alta", "saldo")})


def seed_related(spark, folder):
    """Synthetic orders per synthetic client: as many clients as customers and as many orders as orders, each drawn to some client."""
    many = {n: table(spark, folder, n).count() for n in ("customer", "orders")}
    order = [G.SeedColumn("n", "bigint", unique=True, nullable=False), G.SeedColumn("client", "bigint")]
    made = G.seed_related(spark, {"orders": (order, many["orders"]), "client": (CLIENTS, many["customer"])}, {("orders", "client"): ("client", "id")})
    return made["client"].join(made["orders"].select(F.col("client").alias("id")), "id").groupBy("id").agg(F.count("*").alias("orders"))


def export_tables(spark, folder):
    """Scripts of the picked tables, written and read back; one table lacks the column to order by, and the others are written all the same."""
    known = {"NATION": False, "CUSTOMER": False, "REGION": False, "SUPPLIER": True, "PART": False, "ORDERS": False}
    names, notes = Z.pick_tables(["nation", "customer", "supplier", "part"], ["region", "Nation", "ghost", "orders"], ["part"], known)
    keys = {"NATION": ["n_nationkey"], "CUSTOMER": ["c_custkey"], "REGION": ["missing"], "ORDERS": ["o_orderkey"]}
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    status = Z.export_tables({n: (table(spark, folder, n.lower()), keys[n]) for n in names}, path)
    seen = local_rows(spark, [(n, "status", f"{s} {k}") for n, s, k, _ in status] + [(n, "skipped", why) for n, why in notes], "table string, kind string, value string")
    for name in [n for n, s, _, _ in status if s == "OK"]:
        seen = seen.unionByName(spark.read.text(f"{path}/{name}").select(F.lit(name).alias("table"), F.lit("line").alias("kind"), "value"))
    return seen


def dependency_order(spark, folder):
    """Sections in the order objects depend on each other: their place, objects, first and last one, and whether they lie apart."""
    placed = durable(O.order_by_dependency(editions(spark, folder)[1].select("section", "name")).withColumn("at", F.monotonically_increasing_id()))
    per = placed.groupBy("section").agg(F.count("*").alias("objects"), F.min("at").alias("from"), F.max("at").alias("to"), F.min_by("name", "at").alias("first"), F.max_by("name", "at").alias("last"))
    # One row a section is left to rank.
    by = Window.orderBy("from")
    return per.select("section", "objects", "first", "last", F.row_number().over(by).cast("bigint").alias("place"),
                      F.coalesce(F.lag("to").over(by) < F.col("from"), F.lit(True)).alias("apart"))


def sample_input(spark, folder):
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return G.sample_input_file(rows, POSITIONAL)


def split_history(spark, folder):
    hist = runs(spark, folder).withColumn("task", F.concat(F.lit("revisar 12345678Z en "), "solution")).drop("agents")
    kept, old = Z.split_history(hist)
    count = lambda d, n: d.groupBy("task").agg(F.count("*").alias("runs")).withColumn("part", F.lit(n))
    return count(kept, "kept").unionByName(count(old.drop("month"), "archive"))


QUERIES = {
    "q_body_signature": body_signature, "q_inventory": inventory, "q_used_tables": users_by_section,
    "q_inventory_diff": inventory_diff, "q_delivery_plan": delivery_plan, "q_failed_sections": failed_sections,
    "q_compare_trees": compare_trees, "q_insert_sql": insert_sql, "q_terminated_rows": terminated_rows,
    "q_structured_rows": structured_rows, "q_commit_log": commit_log, "q_commit_paths": commit_paths,
    "q_parse_diff": parse_diff, "q_seed": seed_rows, "q_seed_related": seed_related, "q_sample_input": sample_input,
    "q_split_history": split_history, "q_export_tables": export_tables, "q_dependency_order": dependency_order,
}


def _norm(c):
    return (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v]+\\n', chr(10), 'g'),"
            " '\\s+$', ''), '^\\s+', '')")


_CARDS = """base AS (SELECT d.*, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) = 1 AS toxic, {section} AS s, {name} AS n
  FROM documents d LEFT JOIN labels l USING (doc_id)),
ed AS (SELECT 'old' AS e, s, n, text AS body, false AS off FROM base WHERE source <> 'src1'
  UNION ALL SELECT 'new', s, n, CASE WHEN quality = 1 THEN text || chr(10) || 'END; -- v2' ELSE text || '  ' || chr(13) || chr(10) END, toxic FROM base WHERE source <> 'src2'),
nm AS (SELECT e, CASE WHEN n LIKE 'PACKAGE %' THEN 'paquetes' ELSE s END AS section, regexp_replace(n, '^(PACKAGE BODY|PACKAGE|PROCEDURE) ', '') AS name,
  n LIKE 'PACKAGE BODY %' AS place, {norm} AS body, off FROM ed),
cards AS (SELECT e, section, name, string_agg(body, chr(10) ORDER BY place) AS body, bool_or(off) AS off,
  sum(CASE WHEN body = '' THEN 0 ELSE len(string_split(body, chr(10))) END)::BIGINT AS line_count FROM nm GROUP BY ALL),
sg AS (SELECT *, substr(sha256({again}), 1, 16) AS signature, CASE WHEN off THEN 'DISABLED' ELSE 'VALID' END AS state FROM cards)""".format(
    section=SECTION, name=NAME.replace("TXT", "VARCHAR").replace("doc_id DIV 4", "doc_id // 4"), norm=_norm("body"), again=_norm("body"))
_DIFF = """df AS (SELECT coalesce(o.section, n.section) AS section, coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'new' WHEN n.name IS NULL THEN 'removed'
  WHEN o.signature <> n.signature THEN 'modified' WHEN o.state <> n.state THEN 'state changed' END AS change
  FROM (SELECT * FROM sg WHERE e = 'old') o FULL JOIN (SELECT * FROM sg WHERE e = 'new') n ON o.section = n.section AND o.name = n.name),
diff AS (SELECT * FROM df WHERE change IS NOT NULL)"""
_USES = r"""w AS (SELECT DISTINCT upper(x) AS t FROM (SELECT unnest(string_split_regex(text, '[^\p{L}\p{N}_]+')) AS x FROM benchmark) WHERE length(x) >= 6),
tk AS (SELECT DISTINCT e, section, name, upper(x) AS t FROM (SELECT e, section, name, unnest(string_split_regex(upper(body), '[^\p{L}\p{N}_]+')) AS x FROM cards)),
us AS (SELECT e, section, name, t FROM tk JOIN w USING (t))"""
_HEX = "('0x' || substr(md5('{salt}:' || n), 1, 12))::BIGINT"

ORACLE = {
    "q_body_signature": f"""SELECT doc_id, substr(sha256(b), 1, 16) AS signature, CASE WHEN b = '' THEN 0 ELSE len(string_split(b, chr(10))) END AS lines
FROM (SELECT doc_id, {_norm('text')} AS b FROM documents)""",
    "q_inventory": f"""WITH {_CARDS}, {_USES} SELECT s.section, s.name, state, signature, line_count, count(t) AS used, md5(coalesce(string_agg(t, ',' ORDER BY t), '')) AS used_digest
FROM sg s LEFT JOIN us u ON u.e = s.e AND u.section = s.section AND u.name = s.name WHERE s.e = 'new' GROUP BY ALL""",
    "q_used_tables": f"""WITH {_CARDS}, {_USES} SELECT t AS "table", section, count(*) AS objects FROM us WHERE e = 'old' GROUP BY ALL""",
    "q_inventory_diff": f"WITH {_CARDS}, {_DIFF} SELECT * FROM diff",
    "q_delivery_plan": f"""WITH {_CARDS}, {_DIFF} SELECT *, CASE WHEN change = 'removed' THEN 'comment'
  WHEN section = 'secuencias' AND change <> 'new' THEN 'hold' ELSE 'deliver' END AS route FROM diff""",
    "q_failed_sections": f"""WITH {_CARDS}, {_DIFF} SELECT 'change' AS what, section, name, change AS detail FROM diff WHERE section IN ('secuencias', 'triggers')
UNION ALL SELECT 'card', section, name, signature || ' false' FROM sg WHERE e = 'new' AND section IN ('secuencias', 'triggers')
UNION ALL SELECT 'card', section, name, signature || ' true' FROM sg WHERE e = 'old' AND section NOT IN ('secuencias', 'triggers')""",
    "q_compare_trees": """SELECT path, status FROM (SELECT d.source || '/' || d.doc_id AS path, CASE WHEN source = 'src4' THEN 'missing' WHEN source = 'src3' THEN 'extra'
  WHEN toxic = 1 THEN 'different' END AS status FROM documents d LEFT JOIN labels USING (doc_id)) WHERE status IS NOT NULL""",
    "q_insert_sql": """SELECT 'INSERT INTO NATION (n_nationkey, n_name, n_regionkey) VALUES (' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ');' AS statement FROM nation
UNION ALL SELECT 'INSERT INTO SUPPLIER (s_suppkey, s_name, s_nationkey, s_acctbal) VALUES (' || s_suppkey || ', ''' || s_name || ''', ' || s_nationkey || ', ' ||
  regexp_replace(s_acctbal::VARCHAR, '\\.0$', '') || ');' FROM supplier
UNION ALL SELECT 'INSERT INTO ORDERS (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) VALUES (' || o_orderkey || ', ' || o_custkey || ', ''' ||
  o_orderstatus || ''', ' || regexp_replace(o_totalprice::VARCHAR, '\\.0$', '') || ', ''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ''', ''' || o_orderpriority || ''');' FROM orders""",
    "q_terminated_rows": """SELECT c_custkey::VARCHAR AS key, c_name || chr(10) || 'x' AS name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT 'rejected', '4', md5(c_custkey || '|@#@|' || c_name || '@@LF@@x|@#@|' || CASE WHEN c_acctbal < 0 THEN '@@NULL@@' ELSE c_mktsegment END || '|@#@|extra')
FROM customer WHERE c_nationkey = 3""",
    "q_structured_rows": """SELECT 'c' AS file, c_custkey AS line_no, lpad(c_custkey::VARCHAR, 10, '0') AS key, rpad(c_name, 20, ' ') AS a, substr(c_mktsegment, 1, 4) AS b FROM customer
UNION ALL SELECT 'o', o_orderkey, o_orderkey::VARCHAR, 'a;b "' || o_orderstatus || '"', o_orderpriority FROM orders""",
    "q_commit_log": """WITH t AS (SELECT *, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (ORDER BY o_orderkey) AS h FROM orders)
SELECT 'r' || h AS revision, count(*) AS files, count(*) FILTER (o_orderpriority = '2-HIGH') AS renamed, CASE WHEN h IS NOT NULL THEN 'ana' END AS author,
  CASE WHEN h IS NOT NULL THEN 'cambio' END AS message FROM t GROUP BY h""",
    "q_commit_paths": """SELECT 'src/f' || o_custkey AS path, max_by(CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'R' ELSE 'M' END, o_orderkey) AS action
FROM orders GROUP BY o_custkey""",
    "q_parse_diff": """WITH t AS (SELECT *, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (ORDER BY o_orderkey) AS h FROM orders)
SELECT 'src/F' || f.o_custkey || '.cs' AS file, count(*) FILTER (t.o_orderpriority = '1-URGENT') AS added, count(*) FILTER (t.o_orderpriority = '2-HIGH') AS removed, count(*) AS lines
FROM t JOIN orders f ON f.o_orderkey = t.h GROUP BY f.o_custkey""",
    "q_seed": f"""SELECT n AS id, CASE WHEN length('Nombre ' || n) <= 14 THEN 'Nombre ' || n ELSE right('Nombre ' || n, 14) END AS nombre,
  (CASE WHEN {_HEX.format(salt='alta')} % 10 <> 0 THEN DATE '2020-01-01' + ({_HEX.format(salt='alta')} % 1826)::INT END)::VARCHAR AS alta,
  (CASE WHEN {_HEX.format(salt='saldo')} % 10 <> 0 THEN {_HEX.format(salt='saldo')} % 1000 END)::VARCHAR AS saldo
FROM (SELECT 900000 + c_custkey AS n FROM customer)""",
    "q_seed_related": f"""SELECT id, count(*) AS orders FROM (SELECT 900000 + {_HEX.format(salt='orders.client')} % (SELECT count(*) FROM customer) AS id
  FROM (SELECT 899999 + row_number() OVER () AS n FROM orders)) GROUP BY 1""",
    "q_export_tables": """WITH c AS (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders) AS o)
SELECT 'NATION' AS "table", 'line' AS kind, 'INSERT INTO NATION (n_nationkey, n_name, n_regionkey) VALUES (' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ');' AS value FROM nation
UNION ALL SELECT 'CUSTOMER', 'line', 'INSERT INTO CUSTOMER (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) VALUES (' || c_custkey || ', ''' || c_name || ''', ' || c_nationkey || ', ' ||
  regexp_replace(c_acctbal::VARCHAR, '\\.0$', '') || ', ''' || c_mktsegment || ''');' FROM customer
UNION ALL SELECT 'ORDERS', 'line', 'INSERT INTO ORDERS (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) VALUES (' || o_orderkey || ', ' || o_custkey || ', ''' ||
  o_orderstatus || ''', ' || regexp_replace(o_totalprice::VARCHAR, '\\.0$', '') || ', ''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ''', ''' || o_orderpriority || ''');' FROM orders
UNION ALL SELECT t, 'line', l FROM (VALUES ('NATION'), ('CUSTOMER'), ('ORDERS')) AS a(t), (VALUES ('SET DEFINE OFF;'),
  ('ALTER SESSION SET NLS_DATE_FORMAT=''YYYY-MM-DD HH24:MI:SS'';'), ('ALTER SESSION SET NLS_TIMESTAMP_FORMAT=''YYYY-MM-DD HH24:MI:SS'';'), ('commit;')) AS b(l)
UNION ALL SELECT t, 'line', '-- Inserts ' || t FROM (VALUES ('NATION'), ('CUSTOMER'), ('ORDERS')) AS a(t)
UNION ALL SELECT 'NATION', 'status', 'OK ' || n FROM c UNION ALL SELECT 'CUSTOMER', 'status', 'OK ' || c FROM c UNION ALL SELECT 'ORDERS', 'status', 'OK ' || o FROM c
UNION ALL SELECT * FROM (VALUES ('REGION', 'status', 'ERROR 0'), ('SUPPLIER', 'skipped', 'orphan'), ('GHOST', 'skipped', 'not in the catalog'))""",
    "q_dependency_order": f"""WITH {_CARDS}, b AS (SELECT s, n, regexp_replace(n, '^PACKAGE (BODY )?', '') AS clean, n LIKE 'PACKAGE BODY %' AS body,
  CASE s WHEN 'secuencias' THEN 1 WHEN 'vistas' THEN 2 WHEN 'procedimientos' THEN 4 ELSE 6 END AS r FROM base WHERE source <> 'src2'),
k AS (SELECT *, row_number() OVER w AS up, count(*) OVER (PARTITION BY s) AS objects FROM b WINDOW w AS (PARTITION BY s ORDER BY clean, body, n))
SELECT s AS section, objects, max(n) FILTER (up = 1) AS "first", max(n) FILTER (up = objects) AS "last", row_number() OVER (ORDER BY r) AS place, true AS apart FROM k GROUP BY s, r, objects""",
    "q_sample_input": "SELECT lpad(c_custkey::VARCHAR, 10, '0') || rpad(c_name, 20, ' ') || rpad(c_mktsegment, 4, ' ') AS value FROM customer",
    "q_split_history": """WITH r AS (SELECT *, 'revisar [PII] en ' || CASE WHEN user_id % 10 = 0 THEN '' ELSE 'u' || user_id END AS task,
  row_number() OVER (ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S') DESC, event_id DESC) AS rn FROM events)
SELECT task, count(*) AS runs, CASE WHEN rn <= 500 THEN 'kept' ELSE 'archive' END AS part FROM r GROUP BY ALL""",
}
