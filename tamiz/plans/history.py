"""Registered queries: change history, search, text registry and statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tamiz.operators import history as H
from tamiz.operators import stats as T
from tamiz.operators import texts as K
from tamiz.operators import textsearch as X
from tamiz.plans.base import LINES_SQL, document_lines
from tamiz.session import table


def _text(c):
    return F.col(c).cast("string")


def commits(spark, folder):
    """Orders as commits of the customer's nation."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return orders.join(customer, "o_custkey").select(
        F.col("o_orderkey").alias("revision"), F.col("o_orderdate").alias("ts"), F.col("c_nationkey").alias("solution"),
        "o_orderstatus", "o_totalprice", "o_custkey")


def delta(spark, folder):
    files = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("revision"), F.concat(F.lit("part/"), _text("l_partkey")).alias("path"))
    out = H.delta(commits(spark, folder), datetime(1996, 1, 1), datetime(1997, 12, 31), path="part/1", files=files)
    return out.select("revision", "solution")


def delta_since(spark, folder):
    log = commits(spark, folder)
    registry = log.where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 250000)).select(
        "solution", F.col("ts").alias("cut"))
    new = H.delta_since_last_delivery(log, registry, ["solution"])
    return new.groupBy("solution").agg(F.count("*").alias("commits"), F.min("revision").alias("first_revision"))


MESSAGE = "'Corrige #' || {c} || ' y PED-' || {o} || ' de #' || {c}"


def ticket_ids(spark, folder):
    message = F.expr(MESSAGE.format(c="CAST(o_custkey AS STRING)", o="CAST(o_orderkey AS STRING)"))
    return table(spark, folder, "orders").select(
        "o_orderkey", F.array_join(H.ticket_ids(message), ",").alias("tickets"))


def last_action(spark, folder):
    action = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "M").otherwise("D")
    files = table(spark, folder, "lineitem").select(
        F.concat(F.lit("part/"), _text("l_partkey")).alias("path"), action.alias("action"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", action).alias("seq"))
    return H.last_action(files, "seq")


def diff_summary(spark, folder):
    sign = F.when(F.col("o_orderstatus") == "F", "+").when(F.col("o_orderstatus") == "O", "-").otherwise(" ")
    text = F.concat(F.lit("    public void Metodo"), (F.col("o_orderkey") % 30).cast("string"), F.lit("(int x)"))
    diff = table(spark, folder, "orders").select(
        F.concat(F.lit("cust"), _text("o_custkey")).alias("file"), F.col("o_orderkey").alias("line_no"),
        sign.alias("sign"), text.alias("text"))
    return H.diff_summary(diff).withColumn("symbols", F.array_join("symbols", ","))


def hotspots(spark, folder):
    changes = table(spark, folder, "lineitem").select(
        F.concat(F.lit("part"), _text("l_partkey")).alias("path"), F.col("l_orderkey").alias("revision"))
    sizes = table(spark, folder, "part").select(
        F.concat(F.lit("part"), _text("p_partkey")).alias("path"), F.col("p_size").alias("size"))
    return H.hotspots(changes, sizes).select("path", "churn", "size", "priority")


def shared_suppliers(spark, folder):
    edges = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("solution"), F.col("l_suppkey").alias("project"))
    return H.shared_dependencies(edges)


def version_conflicts(spark, folder):
    packages = table(spark, folder, "part").select(
        F.col("p_type").alias("solution"), F.col("p_name").alias("package"), F.col("p_brand").alias("version"))
    return H.version_conflicts(packages)


def _refs(spark, folder):
    node = lambda p, c: F.concat(F.lit(p + ":"), _text(c))
    n = table(spark, folder, "nation").select(node("n", "n_nationkey").alias("source"), node("r", "n_regionkey").alias("target"))
    c = table(spark, folder, "customer").select(node("c", "c_custkey").alias("source"), node("n", "c_nationkey").alias("target"))
    o = table(spark, folder, "orders").select(node("o", "o_orderkey").alias("source"), node("c", "o_custkey").alias("target"))
    return n.unionByName(c).unionByName(o)


def impact(spark, folder):
    # Some orders refer to a region directly as well, so nodes have several targets; region 99 is referred to by nothing.
    direct = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(
        F.concat(F.lit("o:"), _text("o_orderkey")).alias("source"), F.concat(F.lit("r:"), (F.col("o_custkey") % 5).cast("string")).alias("target"))
    edges = _refs(spark, folder).unionByName(direct)
    starts = table(spark, folder, "region").select(F.explode(F.array(F.concat(F.lit("r:"), _text("r_regionkey")), F.lit("r:99"))).alias("node"))
    layers = edges.select(F.col("source").alias("node"), F.substring_index("source", ":", 1).alias("layer"))
    return H.impact(edges, starts, layers, depth=5)


def unreferenced_customers(spark, folder):
    symbols = table(spark, folder, "customer").select(F.col("c_custkey").alias("symbol"), "c_mktsegment")
    refs = table(spark, folder, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("symbol"))
    return H.unreferenced(symbols, refs, F.col("c_mktsegment") == "BUILDING").select("symbol", "verdict")


def reference_coverage(spark, folder):
    public = table(spark, folder, "part").select(F.col("p_partkey").alias("symbol"), "p_brand")
    tests = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("symbol"))
    return H.reference_coverage(public, tests, ["p_brand"])


def classify_commits(spark, folder):
    log = table(spark, folder, "conversations").select("conv_id", "turn", F.col("text").alias("message"))
    return H.classify_commits(log).groupBy("group").agg(F.count("*").alias("commits"))


def _ring(spark, folder):
    """Regions to nations to suppliers, and suppliers in debt back to their region."""
    node = lambda p, c: F.concat(F.lit(p), _text(c))
    nation, supplier = table(spark, folder, "nation"), table(spark, folder, "supplier")
    down = nation.select(node("r", "n_regionkey").alias("source"), node("n", "n_nationkey").alias("target"))
    own = supplier.select(node("n", "s_nationkey").alias("source"), node("s", "s_suppkey").alias("target"))
    back = supplier.where("s_acctbal < 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        node("s", "s_suppkey").alias("source"), node("r", "n_regionkey").alias("target"))
    return down.unionByName(own).unionByName(back)


def graph_ends(spark, folder):
    return H.graph_ends(_ring(spark, folder))


def cycles(spark, folder):
    return H.cycles(_ring(spark, folder))


def search_context(spark, folder):
    out = X.search_context(document_lines(spark, folder), "[0-9]{3}", 2)
    return out.select("file", "line_no", F.md5("match").alias("match"), F.md5("before").alias("before"),
                      F.md5("after").alias("after"))


def search_summary(spark, folder):
    return X.search_summary(document_lines(spark, folder), "[0-9]{3}", 50)


PATTERNS = {"the": [r"(^|\s)the\s", r"(^|\s)there"], "and": [r"(^|\s)and\s"], "digits": [r"[0-9]{5}", r"[0-9]"]}


def match_patterns(spark, folder):
    out = X.match_patterns(document_lines(spark, folder), PATTERNS)
    return out.groupBy("symbol", "pattern").agg(F.count("*").alias("lines"), F.count_distinct("file").alias("files"))


def find_sections(spark, folder):
    out = X.find_sections(document_lines(spark, folder), "than", heading=r"^(.{1,60})$")
    return out.select("file", F.md5("section").alias("section"), "line_no", F.md5("snippet").alias("snippet"))


def undocumented(spark, folder):
    changes = table(spark, folder, "part").select("p_partkey", F.split("p_name", " ")[0].alias("element"))
    notes = document_lines(spark, folder)
    return X.undocumented(changes, notes).groupBy("element").agg(F.count("*").alias("parts"))


def controls(spark, folder):
    pairs = table(spark, folder, "pages").select("page_id", F.inline(X.link_pairs(F.col("html"))))
    return pairs.groupBy("id", "label").agg(F.min("page_id").alias("first_page"), F.count("*").alias("uses"))


def allocate_ids(spark, folder):
    existing = table(spark, folder, "orders").where("o_orderstatus <> 'F'").select((F.col("o_orderkey") + 1000).alias("id"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "error").when(
        F.col("c_mktsegment") == "MACHINERY", "message").otherwise("screen")
    requests = table(spark, folder, "customer").select(F.col("c_custkey").alias("request"), kind.alias("kind"))
    return K.allocate_ids(existing, requests)


def expand_languages(spark, folder):
    docs = table(spark, folder, "documents")
    texts = docs.select(F.col("doc_id").alias("id"), "lang", F.md5("text").alias("text"))
    existing = table(spark, folder, "labels").where("quality = 1").select(
        F.col("doc_id").alias("id"), F.lit("en").alias("lang"))
    return K.expand_languages(texts, docs.select("lang"), existing)


def link_controls(spark, folder):
    pages = table(spark, folder, "pages")
    links = pages.select("page_id", F.col("url").alias("page"), F.inline(X.link_pairs(F.col("html"))))
    shown = links.select("page", F.col("id").alias("control"), "label").distinct()
    kind = F.when(F.length("label") % 3 == 0, "error").otherwise("screen")
    texts = links.groupBy("label").agg((F.min("page_id") + 3000).alias("id")).withColumn("kind", kind)
    known = pages.join(table(spark, folder, "labels").where("quality = 1").select(F.col("doc_id").alias("page_id")),
                       "page_id", "left_semi")
    return K.link_controls(shown, texts, known.select(F.upper("url").alias("page")))


_ID = "CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1000000 ELSE CAST(floor(c_custkey / 2) AS BIGINT) END"


def text_changes(spark, folder):
    customer = table(spark, folder, "customer")
    key = _text("c_custkey")
    old = customer.select(F.concat(F.lit("k"), key).alias("control"), F.expr(_ID).alias("id"), F.col("c_name").alias("text"))
    debt, seg = F.col("c_acctbal") < 0, F.col("c_mktsegment")
    new = customer.select(
        F.when(debt, F.concat(F.lit("m"), key)).when(seg == "MACHINERY", F.concat(F.lit("n"), key))
        .otherwise(F.concat(F.lit("k"), key)).alias("control"),
        F.when(debt, F.col("c_name")).when(seg == "MACHINERY", F.concat(F.lit("new "), "c_name"))
        .when(seg == "BUILDING", F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")).alias("text"))
    return K.classify_text_changes(old, new, old.select("id", "control")).withColumn("id", F.col("id").cast("string"))


def runs(spark, folder):
    """Events as runs: the type gives the status, the user the solution."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "purchase", "Success").when(F.col("event_type") == "error", "fail").when(
        F.col("event_type") == "view", "partial").otherwise("other")
    name = F.when(F.col("user_id") % 10 == 0, "").otherwise(F.concat(F.lit("u"), _text("user_id")))
    agents = F.array(F.concat(F.lit("plan"), (k % 3).cast("string")), F.concat(F.lit("check"), (k % 2).cast("string")))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        name.alias("solution"), status.alias("status"), agents.alias("agents"))


def run_summary(spark, folder):
    return T.run_summary(runs(spark, folder))


def by_solution(spark, folder):
    return T.by_solution(runs(spark, folder))


def agent_usage(spark, folder):
    return T.agent_usage(runs(spark, folder))


def trend(spark, folder):
    last = table(spark, folder, "events").agg(F.max(F.to_date("ts")).alias("d")).first()["d"]
    return T.trend(runs(spark, folder), last)


def history_list(spark, folder):
    return T.history_list(runs(spark, folder), 50, since="2024-01-10").select("id", "timestamp", "status")


def test_rollup(spark, folder):
    kind = lambda t: F.count_if(F.col("event_type") == t)
    counters = table(spark, folder, "events").groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type") != "signup").alias("executed"),
        kind("purchase").alias("passed"), kind("error").alias("failed"), kind("click").alias("error"),
        F.lit(0).cast("bigint").alias("timeout"), F.lit(None).cast("bigint").alias("aborted"),
        kind("view").alias("notExecuted"), F.lit(0).cast("bigint").alias("inconclusive"))
    return T.test_rollup(counters)


QUERIES = {
    "q_delta": delta, "q_delta_since": delta_since, "q_ticket_ids": ticket_ids, "q_last_action": last_action,
    "q_diff_summary": diff_summary, "q_hotspots": hotspots, "q_shared_suppliers": shared_suppliers,
    "q_version_conflicts": version_conflicts, "q_impact": impact,
    "q_unreferenced_customers": unreferenced_customers, "q_reference_coverage": reference_coverage,
    "q_classify_commits": classify_commits, "q_graph_ends": graph_ends, "q_cycles": cycles,
    "q_search_context": search_context, "q_search_summary": search_summary, "q_match_patterns": match_patterns,
    "q_sections": find_sections, "q_undocumented": undocumented, "q_controls": controls,
    "q_allocate_ids": allocate_ids, "q_expand_languages": expand_languages, "q_link_controls": link_controls,
    "q_text_changes": text_changes, "q_run_summary": run_summary, "q_by_solution": by_solution,
    "q_agent_usage": agent_usage, "q_trend": trend, "q_history_list": history_list, "q_test_rollup": test_rollup,
}

_RUNS = """runs AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  CASE WHEN user_id % 10 = 0 THEN '(sin nombre)' ELSE 'u' || user_id END AS solution,
  CASE event_type WHEN 'purchase' THEN 'Success' WHEN 'error' THEN 'fail' WHEN 'view' THEN 'partial' ELSE 'other' END AS status,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
_COMMITS = """commits AS (SELECT o_orderkey AS revision, o_orderdate AS ts, c_nationkey AS solution, o_orderstatus, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
_RING = """ring AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 0)"""
_LINKS = r"""links AS (SELECT page_id, url AS page, regexp_extract(a, 'href="([^"]*)"', 1) AS id, regexp_extract(a, '>([^<]*)<', 1) AS label
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a FROM pages))"""
_GROUP_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(m, '{w}')" for w in words) + f" THEN '{name}'"
    for name, words in H.V.COMMIT_GROUPS) + " ELSE 'other' END"
_PATTERN_SQL = " UNION ALL ".join(
    f"SELECT file, '{s}' AS symbol, CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{p}'" for p in ps)
    + " END AS pattern FROM lines" for s, ps in PATTERNS.items())

ORACLE = {
    "q_delta": f"""WITH {_COMMITS} SELECT revision, solution FROM commits c
  WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = c.revision AND starts_with('part/' || l_partkey, 'part/1'))""",
    "q_delta_since": f"""WITH {_COMMITS}, cut AS (SELECT solution, max(ts) AS cut FROM commits
  WHERE o_orderstatus = 'P' AND o_totalprice < 250000 GROUP BY solution)
SELECT solution, count(*) AS commits, min(revision) AS first_revision FROM commits JOIN cut USING (solution) WHERE ts > cut GROUP BY solution""",
    "q_ticket_ids": """SELECT o_orderkey, CASE WHEN o_custkey BETWEEN 10 AND 9999999 THEN '#' || o_custkey || ',' ELSE '' END
  || 'PED-' || o_orderkey AS tickets FROM orders""",
    "q_last_action": """SELECT 'part/' || l_partkey AS path, max_by(a, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, a)) AS action
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' ELSE 'D' END AS a FROM lineitem) GROUP BY 1""",
    "q_diff_summary": """WITH f AS (SELECT o_custkey, 'Metodo' || (o_orderkey % 30) AS symbol, min(o_orderkey) AS first_at FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY first_at) AS pos FROM f),
s AS (SELECT o_custkey, string_agg(symbol, ',' ORDER BY pos) AS symbols FROM r WHERE pos <= 10 GROUP BY o_custkey)
SELECT 'cust' || o.o_custkey AS file, count(*) FILTER (o_orderstatus = 'F') AS added, count(*) FILTER (o_orderstatus = 'O') AS removed,
  coalesce(max(s.symbols), '') AS symbols FROM orders o LEFT JOIN s USING (o_custkey) GROUP BY o.o_custkey""",
    "q_hotspots": """WITH b AS (SELECT p_partkey, p_size AS size, count(DISTINCT l_orderkey) AS churn FROM part JOIN lineitem ON l_partkey = p_partkey
  WHERE p_size > 0 GROUP BY ALL),
c AS (SELECT quantile_cont(churn, 1/3) AS cl, quantile_cont(churn, 2/3) AS ch, quantile_cont(size, 1/3) AS sl, quantile_cont(size, 2/3) AS sh FROM b),
l AS (SELECT *, CASE WHEN churn > ch THEN 3 WHEN churn > cl THEN 2 ELSE 1 END AS x, CASE WHEN size > sh THEN 3 WHEN size > sl THEN 2 ELSE 1 END AS y FROM b, c)
SELECT 'part' || p_partkey AS path, churn, size, CASE WHEN x + y = 6 THEN 'high' WHEN greatest(x, y) = 3 THEN 'medium' ELSE 'low' END AS priority
FROM l ORDER BY x + y DESC, churn DESC, size DESC, path LIMIT 15""",
    "q_shared_suppliers": """SELECT l_suppkey AS project, count(DISTINCT l_partkey) AS impact FROM lineitem GROUP BY 1 HAVING impact > 1""",
    "q_version_conflicts": """WITH p AS (SELECT p_name AS package, p_brand AS version, count(DISTINCT p_type) AS solutions FROM part GROUP BY ALL)
SELECT *, versions FROM (SELECT package, version, solutions, count(*) OVER (PARTITION BY package) AS versions FROM p) WHERE versions > 1""".replace("SELECT *, versions", "SELECT *"),
    "q_impact": """WITH c AS (SELECT n_regionkey AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
n AS (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1),
o AS (SELECT n_regionkey AS r, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
p AS (SELECT o_orderkey, o_custkey % 5 AS r FROM orders WHERE o_orderstatus = 'P'), d AS (SELECT r, count(*) AS n FROM p GROUP BY 1),
twice AS (SELECT n_regionkey AS r, count(*) AS n FROM p JOIN orders USING (o_orderkey) JOIN customer ON orders.o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE p.r = n_regionkey GROUP BY 1)
SELECT 'r:' || n.r AS start, n.n + coalesce(d.n, 0) AS direct, c.n + o.n - coalesce(t.n, 0) AS indirect, n.n + c.n + o.n + coalesce(d.n, 0) - coalesce(t.n, 0) AS total,
  3::BIGINT AS layers, false AS cut, 'high' AS impact
FROM n JOIN c USING (r) JOIN o USING (r) LEFT JOIN d USING (r) LEFT JOIN twice t USING (r)
UNION ALL SELECT 'r:99', 0, 0, 0, 0, false, 'low'""",
    "q_unreferenced_customers": """SELECT c_custkey AS symbol, CASE WHEN c_mktsegment = 'BUILDING' THEN 'inconclusive' ELSE 'dead' END AS verdict
FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""",
    "q_reference_coverage": """SELECT p_brand, count(*) AS symbols, count(*) FILTER (u) AS covered, round(count(*) FILTER (u) * 100 / count(*), 2) AS percent
FROM (SELECT p_brand, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS u FROM part) GROUP BY p_brand""",
    "q_classify_commits": f"""SELECT "group", count(*) AS commits FROM (SELECT {_GROUP_SQL} AS "group" FROM (SELECT lower(text) AS m FROM conversations)
  WHERE NOT (contains(m, 'merge') OR contains(m, 'wip') OR contains(m, 'typo'))) GROUP BY 1""",
    "q_graph_ends": f"""WITH {_RING}, n AS (SELECT source AS node FROM ring UNION SELECT target FROM ring)
SELECT * FROM (SELECT node, node NOT IN (SELECT target FROM ring) AS entry, node NOT IN (SELECT source FROM ring) AS leaf FROM n) WHERE entry OR leaf""",
    "q_cycles": f"""WITH RECURSIVE {_RING}, walk AS (SELECT DISTINCT source AS a, target AS b FROM ring
  UNION SELECT w.a, r.target FROM walk w JOIN ring r ON r.source = w.b),
pair AS (SELECT x.a, x.b FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a)
SELECT max(b) AS cycle, a AS node FROM pair GROUP BY a""",
    "q_search_context": f"""WITH {LINES_SQL}, h AS (SELECT * FROM lines WHERE regexp_matches(text, '[0-9]{{3}}'))
SELECT h.file, h.line_no, md5(trim(h.text)) AS match,
  md5(coalesce(string_agg(l.text, chr(10) ORDER BY l.line_no) FILTER (l.line_no < h.line_no), '')) AS before,
  md5(coalesce(string_agg(l.text, chr(10) ORDER BY l.line_no) FILTER (l.line_no > h.line_no), '')) AS after
FROM h JOIN lines l ON l.file = h.file AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2 GROUP BY h.file, h.line_no, h.text""",
    "q_search_summary": f"""WITH {LINES_SQL} SELECT count(*) AS matches, count(DISTINCT file) AS files_matched, count(*) > 50 AS truncated
FROM lines WHERE regexp_matches(text, '[0-9]{{3}}')""",
    "q_match_patterns": f"""WITH {LINES_SQL} SELECT symbol, pattern, count(*) AS lines, count(DISTINCT file) AS files FROM ({_PATTERN_SQL})
WHERE pattern IS NOT NULL GROUP BY ALL""",
    "q_sections": f"""WITH {LINES_SQL}, m AS (SELECT *, CASE WHEN regexp_full_match(text, '.{{1,60}}') THEN trim(text) END AS title FROM lines),
s AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM m)
SELECT file, md5(coalesce(section, '')) AS section, line_no, md5(CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '...' ELSE t END) AS snippet
FROM (SELECT *, trim(text) AS t FROM s WHERE contains(lower(text), 'than'))""",
    "q_undocumented": r"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM documents)
SELECT split_part(p_name, ' ', 1) AS element, count(*) AS parts FROM part WHERE split_part(p_name, ' ', 1) NOT IN (SELECT word FROM w) GROUP BY 1""",
    "q_controls": f"WITH {_LINKS} SELECT id, label, min(page_id) AS first_page, count(*) AS uses FROM links GROUP BY id, label",
    "q_allocate_ids": """WITH ex AS (SELECT o_orderkey + 1000 AS id FROM orders WHERE o_orderstatus <> 'F'),
req AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY request) AS pos FROM (SELECT c_custkey AS request,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'error' WHEN 'MACHINERY' THEN 'message' ELSE 'screen' END AS kind FROM customer)),
r AS (SELECT * FROM (VALUES ('error', 1000, 1999), ('message', 2000, 2999), ('screen', 3000, 100000000)) AS v(kind, low, high)),
free AS (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) AS pos FROM r,
  LATERAL (SELECT unnest(range(low, least(high + 1, low + (SELECT count(*) FROM ex) + (SELECT count(*) FROM req)))) AS id) x
  WHERE id NOT IN (SELECT id FROM ex)),
given AS (SELECT request, kind, id FROM req JOIN free USING (kind, pos)),
rest AS (SELECT request, kind, row_number() OVER (ORDER BY request) AS pos FROM req WHERE request NOT IN (SELECT request FROM given)),
more AS (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM (SELECT unnest(range(3000, 3000 + (SELECT count(*) FROM ex) + 2 * (SELECT count(*) FROM req))) AS id)
  WHERE id NOT IN (SELECT id FROM ex) AND id NOT IN (SELECT id FROM given))
SELECT request, kind, id, false AS overflow FROM given UNION ALL SELECT request, kind, id, true FROM rest JOIN more USING (pos)""",
    "q_expand_languages": """WITH l AS (SELECT DISTINCT lang FROM documents)
SELECT d.doc_id AS id, l.lang, CASE WHEN d.lang = l.lang THEN md5(d.text) ELSE '[TEXTO_' || l.lang || ']' END AS text
FROM documents d, l WHERE NOT (l.lang = 'en' AND d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))""",
    "q_link_controls": f"""WITH {_LINKS}, t AS (SELECT label, min(page_id) + 3000 AS id FROM links GROUP BY label),
k AS (SELECT DISTINCT upper(url) AS page FROM pages WHERE page_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT coalesce(k.page, l.page) AS page, l.id AS control, t.id FROM (SELECT DISTINCT page, id, label FROM links) l
JOIN t ON t.label = l.label AND length(t.label) % 3 <> 0 LEFT JOIN k ON k.page = upper(l.page)""",
    "q_text_changes": f"""WITH o AS (SELECT *, {_ID.replace('c_custkey / 2', 'c_custkey // 2')} AS id FROM customer), u AS (SELECT id, count(*) AS n FROM o GROUP BY id)
SELECT CASE WHEN c_acctbal < 0 THEN 'm' WHEN c_mktsegment = 'MACHINERY' THEN 'n' ELSE 'k' END || c_custkey AS control,
  CASE WHEN c_acctbal < 0 THEN 'relink' WHEN c_mktsegment = 'MACHINERY' THEN 'add' WHEN c_mktsegment <> 'BUILDING' THEN 'same'
    WHEN n <= 1 THEN 'update' ELSE 'new id and relink' END AS action,
  (CASE WHEN c_acctbal >= 0 AND c_mktsegment = 'MACHINERY' THEN NULL ELSE id END)::VARCHAR AS id FROM o JOIN u USING (id)""",
    "q_run_summary": f"""WITH {_RUNS} SELECT count(*) AS total, count(*) FILTER (lower(status) = 'success') AS success, count(*) FILTER (status = 'fail') AS fail,
  count(*) FILTER (status = 'partial') AS partial, min(substr(timestamp, 1, 10)) AS period_from, max(substr(timestamp, 1, 10)) AS period_to,
  round(count(*) FILTER (lower(status) = 'success') * 100 / count(*), 2) AS success_pct FROM runs""",
    "q_by_solution": f"WITH {_RUNS} SELECT solution AS name, count(*) AS total, count(*) FILTER (status = 'Success') AS success FROM runs GROUP BY 1",
    "q_agent_usage": f"""WITH {_RUNS} SELECT name, count(*) AS count FROM (SELECT unnest(['plan' || (k % 3), 'check' || (k % 2)]) AS name FROM runs) GROUP BY 1""",
    "q_trend": f"""WITH {_RUNS}, d AS (SELECT strftime(unnest(range(m - INTERVAL 6 DAY, m + INTERVAL 1 DAY, INTERVAL 1 DAY)), '%Y-%m-%d') AS date
  FROM (SELECT date_trunc('day', max(ts)) AS m FROM events))
SELECT d.date, count(r.id) AS total, count(r.id) FILTER (status = 'Success') AS success, count(r.id) FILTER (status = 'fail') AS fail,
  count(r.id) FILTER (status = 'partial') AS partial FROM d LEFT JOIN runs r ON substr(r.timestamp, 1, 10) = d.date GROUP BY d.date""",
    "q_history_list": f"WITH {_RUNS} SELECT id, timestamp, status FROM runs WHERE timestamp >= '2024-01-10' ORDER BY timestamp DESC, id DESC LIMIT 50",
    "q_test_rollup": """WITH c AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS passed,
  count(*) FILTER (event_type IN ('error', 'click')) AS failed, greatest(count(*) FILTER (event_type = 'view'), count(*) FILTER (event_type = 'signup')) AS skipped
  FROM events GROUP BY user_id)
SELECT sum(total)::BIGINT AS total, sum(passed)::BIGINT AS passed, sum(failed)::BIGINT AS failed, sum(skipped)::BIGINT AS skipped, count(*) AS files FROM c""",
}
