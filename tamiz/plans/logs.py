"""Registered queries: error logs. The log is written by the events, one line per event."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V
from tamiz.functions import logtext as L
from tamiz.operators import logs as O
from tamiz.operators.ordered import rank_whole
from tamiz.plans.base import LINES_SQL, document_lines
from tamiz.session import durable, table

# Text of a log line, read the same way by both SQL dialects; k is the number in props.
LINE = """CASE event_type
  WHEN 'error' THEN CASE WHEN k % 5 = 0 THEN 'Warn' WHEN k % 5 = 1 THEN 'cErrores' ELSE 'Error' END || ': (' ||
    CAST(day(ts) AS TXT) || '/' || CAST(month(ts) AS TXT) || '/' || CAST(year(ts) AS TXT) || ' ' ||
    CAST(hour(ts) AS TXT) || ':' || lpad(CAST(minute(ts) AS TXT), 2, '0') || ') - Codigo error: ' || CAST(k % 4 AS TXT) ||
    ' Codigo error sql: 0 Descripción error: fallo ' || CASE WHEN k % 3 = 0 THEN 'ORA-0010' || CAST(k % 2 AS TXT) ||
    ' en tabla ' || chr(39) || 'PEDIDOS' || chr(39) ELSE 'System.InvalidCastException: valor' END || ' pedido ' || CAST(event_id AS TXT)
  WHEN 'purchase' THEN CAST(year(ts) AS TXT) || '-' || lpad(CAST(month(ts) AS TXT), 2, '0') || '-' || lpad(CAST(day(ts) AS TXT), 2, '0') ||
    ' ' || lpad(CAST(hour(ts) AS TXT), 2, '0') || ':' || lpad(CAST(minute(ts) AS TXT), 2, '0') || ':00' ||
    CASE k % 3 WHEN 0 THEN ' ERROR ' WHEN 1 THEN ' INFO ' ELSE ' ' END || 'Servicio - ' ||
    CASE WHEN k % 2 = 0 THEN 'Tienda.PagoException' ELSE 'sin tipo' END || ': espera ' || CAST(event_id AS TXT)
  WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN '   en System.Web.Pagina.Abrir(String s)' ELSE '   at Tienda.Modulo' || CAST(k % 7 AS TXT) ||
    '.Cobrar(Int n) in C:' || chr(92) || 'src' || chr(92) || 'Pago' || CAST(k % 3 AS TXT) || '.aspx.cs:line ' || CAST(k AS TXT) END
  WHEN 'view' THEN 'detalle System.NullReferenceException: objeto ' || CAST(event_id AS TXT)
  ELSE '   en Tienda.Alta() en C:' || chr(92) || 'src' || chr(92) || 'Alta.ascx.cs:linea 7' END"""


def log_lines(spark, folder):
    """One log file per day of events."""
    events = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    day = F.concat(F.lit("log-"), F.date_format("ts", "yyyy-MM-dd"))
    lines = events.select(day.alias("file"), "event_id", F.expr(LINE.replace("TXT", "STRING")).alias("text"))
    return durable(rank_whole(lines, ["file"], "event_id", "line_no").select("file", "line_no", "text"))


def _events(spark, folder):
    return O.assemble_events(log_lines(spark, folder))


def _described(spark, folder):
    return O.describe_events(_events(spark, folder))


def log_events(spark, folder):
    return _events(spark, folder).select("file", "line_no", "kind", "stamp", F.size("lines").alias("n_lines"),
                                         F.md5(F.array_join("lines", "\n")).alias("digest"))


def log_signatures(spark, folder):
    return O.aggregate_signatures(_described(spark, folder))


def log_files(spark, folder):
    return O.signature_files(_described(spark, folder))


def log_samples(spark, folder):
    got = O.signature_samples(_described(spark, folder))
    return got.select("hash", F.col("sample").cast("bigint").alias("sample"), "file", "line_no",
                      F.md5("text").alias("digest"))


def log_top(spark, folder):
    return O.top_signatures(log_signatures(spark, folder)).select("hash", "count", "exception")


def log_summary(spark, folder):
    """The scan is capped at nine tenths of the lines, newest file first."""
    lines = log_lines(spark, folder)
    cap = lines.count() * 9 // 10
    kept = durable(O.scan_cap(lines.withColumn("mtime", F.to_timestamp(F.substring("file", 5, 10))), cap))
    return O.scan_summary(O.describe_events(O.assemble_events(kept)), lines=kept)


def log_levels_since(spark, folder):
    """Every level, from the middle of the month on."""
    levels = ["ERROR", "FATAL", "WARN", "INFO"]
    events = O.assemble_events(log_lines(spark, folder), levels, since="2024-01-15 00:00:00")
    return events.groupBy("file", "kind").agg(F.count("*").alias("events"), F.sum(F.size("lines")).alias("lines"))


def log_new(spark, folder):
    agg = log_signatures(spark, folder)
    tickets = agg.where(F.col("exception").startswith("COD")).select(
        F.concat(F.lit("[log:"), "hash", F.lit("] "), "exception").alias("title"))
    return O.new_signatures(agg, tickets).select("hash", "count", "is_new")


TRIAGE = [("data", r"^ORA-", 2), ("code", r"NullReference|InvalidCast", 3), ("config", r"^COD", 2)]


def log_triage(spark, folder):
    return O.triage(log_signatures(spark, folder), TRIAGE, ("infra", 1)).select("hash", "category", "priority")


def log_recount(spark, folder):
    lines = log_lines(spark, folder)
    return O.recount_check(lines, O.assemble_events(lines), least_lines=100, ratio=4).select(
        "file", "lines", "events", "doubtful")


def line_cap(spark, folder):
    """Newest files first until the cap; a document's id stands for its time."""
    lines = document_lines(spark, folder)
    cap = lines.count() // 2
    stamped = lines.withColumn("mtime", F.timestamp_seconds(F.substring("file", 4, 20).cast("bigint") * 60))
    kept = O.scan_cap(stamped, cap)
    return kept.groupBy("file").agg(F.count("*").alias("lines"), F.bool_or("scan_truncated").alias("scan_truncated"))


def line_cap_tied(spark, folder):
    """All files of one time: taken by the digests of their names until the cap."""
    lines = document_lines(spark, folder)
    # Every name begins with "doc": one time, though not a literal one, which would fold the join on it away.
    kept = O.scan_cap(lines.withColumn("mtime", F.timestamp_seconds(60 * F.instr("file", "doc"))), lines.count() // 2)
    return kept.groupBy("file").agg(F.count("*").alias("lines"), F.bool_or("scan_truncated").alias("scan_truncated"))


QUERIES = {
    "q_line_cap_tied": line_cap_tied,
    "q_log_events": log_events,
    "q_log_signatures": log_signatures,
    "q_log_files": log_files,
    "q_log_samples": log_samples,
    "q_log_top": log_top,
    "q_log_summary": log_summary,
    "q_log_levels_since": log_levels_since,
    "q_log_new": log_new,
    "q_log_triage": log_triage,
    "q_log_recount": log_recount,
    "q_line_cap": line_cap,
}


def _head_sql(wanted_levels: str, since: str | None) -> str:
    late = f"AND coalesce(try_strptime(stamp, '%Y-%m-%d %H:%M:%S') >= TIMESTAMP '{since}', true)" if since else ""
    return f"""
raw AS (SELECT 'log-' || strftime(ts, '%Y-%m-%d') AS file, event_id, ts, event_type,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
lines AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY event_id) AS line_no, {LINE.replace('TXT', 'VARCHAR')} AS text FROM raw),
marks AS (SELECT *, regexp_extract(text, '{V.LABELLED_HEADER}', ['label','d','m','y','h','mi','s']) AS g,
    regexp_matches(text, '{V.LABELLED_HEADER}') AS is_lab, regexp_matches(text, '{V.STAMP}') AS is_sta,
    regexp_matches(text, '{V.EXCEPTION_WORD}') AS is_exc, regexp_extract(text, '{V.LEVEL_WORD}', 1) AS word,
    regexp_extract(text, '{V.STAMP}', 1) AS sta FROM lines),
levelled AS (SELECT *, CASE WHEN is_lab THEN CASE WHEN lower(g.label) LIKE '%error%' THEN 'ERROR' WHEN lower(g.label) LIKE '%warn%' THEN 'WARNING' ELSE '' END
    ELSE word END AS level, CASE WHEN is_lab THEN g.y || '-' || lpad(g.m, 2, '0') || '-' || lpad(g.d, 2, '0') || ' ' || lpad(g.h, 2, '0') || ':' || g.mi || ':00'
    ELSE sta END AS stamp FROM marks),
kept AS (SELECT *, (level = '' OR level IN ({wanted_levels})) AND (is_lab OR level <> '' OR is_exc) {late} AS keep FROM levelled),
one AS (SELECT *, last_value(CASE WHEN is_lab THEN line_no END IGNORE NULLS) OVER w AS lab_line,
    last_value(CASE WHEN is_lab THEN keep END IGNORE NULLS) OVER w AS lab_keep FROM kept
    WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
two AS (SELECT *, last_value(CASE WHEN is_sta AND NOT is_lab AND NOT coalesce(lab_keep, false) THEN line_no END IGNORE NULLS) OVER w AS sta_line,
    min(CASE WHEN lab_line IS NULL AND is_exc THEN line_no END) OVER w AS dump FROM one
    WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
headed AS (SELECT t.file, t.line_no, t.text, coalesce(greatest(coalesce(lab_line, 0), coalesce(sta_line, 0)), 0) AS h, dump FROM two t),
tied AS (SELECT h.file, h.line_no, h.text, CASE WHEN h.h = 0 THEN h.dump ELSE h.h END AS head,
    CASE WHEN h.h = 0 THEN 'plain' WHEN k.is_lab THEN 'labelled' ELSE 'stamped' END AS kind,
    CASE WHEN h.h = 0 THEN '' ELSE k.stamp END AS stamp, CASE WHEN h.h = 0 THEN h.dump IS NOT NULL ELSE k.keep END AS keep
    FROM headed h LEFT JOIN kept k ON k.file = h.file AND k.line_no = h.h),
ev AS (SELECT file, head AS line_no, kind, stamp, string_agg(text, chr(10) ORDER BY line_no) AS body, count(*) AS n_lines,
    min_by(text, line_no) AS first FROM tied WHERE keep AND line_no - head < 40 GROUP BY file, head, kind, stamp)"""


_NORMAL = "m"
for _rx, _mark in V.MESSAGE_MARKERS:
    _NORMAL = f"regexp_replace({_NORMAL}, '{_rx.replace(chr(39), chr(39) * 2)}', '{_mark}', 'g')"
_DESCRIBED = f"""
d1 AS (SELECT *, nullif(regexp_extract(first, '{V.LABELLED_CODE}', 1), '') AS code, nullif(regexp_extract(body, '{V.EXCEPTION_WORD}', 1), '') AS exc,
    nullif(regexp_extract(body, '{V.ENGINE_CODE}'), '') AS ora, regexp_extract_all(body, '{V.STACK_FRAME}', 1) AS frames,
    regexp_extract(body, '(\\w+)\\.aspx\\.cs', 1) AS page, regexp_extract(body, '(\\w+)\\.ascx\\.cs', 1) AS control FROM ev),
d2 AS (SELECT *, CASE WHEN kind = 'labelled' THEN coalesce(ora, CASE WHEN code <> '0' THEN 'COD' || code END, exc, 'COD' || code, 'SinCodigo')
    ELSE coalesce(exc, 'SinExcepcion') END AS exception,
    coalesce(list_filter(frames, lambda x: NOT regexp_matches(x, '{V.PLATFORM_FRAME}'))[1], frames[1], '') AS origin,
    CASE WHEN page <> '' THEN page ELSE control END AS screen,
    CASE WHEN kind = 'labelled' THEN trim(regexp_extract(first, '{V.LABELLED_MESSAGE}', 1), ' -|' || chr(9))
    ELSE trim(regexp_replace(regexp_replace(first, '{V.STAMP}', ''), '{V.LEVEL_WORD}', ''), ' -|[]:' || chr(9)) END AS m FROM d1),
sig AS (SELECT *, substr(sha1(exception || '|' || origin || '|' || trim({_NORMAL})), 1, 8) AS hash FROM d2),
agg AS (SELECT hash, min_by(exception, (file, line_no)) AS exception, min_by(origin, (file, line_no)) AS origin,
    coalesce(min_by(screen, (file, line_no)) FILTER (screen <> ''), '') AS screen,
    regexp_replace(min_by(m, (file, line_no)), '''[^'']{{0,400}}''', '''<val>''', 'g') AS message, count(*) AS count,
    min(nullif(stamp, '')) AS first_seen, max(nullif(stamp, '')) AS last_seen FROM sig GROUP BY hash)"""
_BASE = "WITH " + _head_sql("'ERROR', 'FATAL'", None)
_FULL = _BASE + "," + _DESCRIBED

#: The log without the last tenth of its lines, newest file first.
_CAPPED = _FULL.replace("lines AS (SELECT file, row_number()", "every AS (SELECT file, row_number()", 1).replace("marks AS (", """used AS (
  SELECT file, n, coalesce(sum(n) OVER (ORDER BY file DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, (SELECT count(*) * 9 // 10 FROM every) AS cap
  FROM (SELECT file, count(*) AS n FROM every GROUP BY file)),
lines AS (SELECT e.file, e.line_no, e.text FROM every e JOIN used u ON e.file = u.file WHERE e.line_no <= u.cap - u.used),
marks AS (""", 1)

ORACLE = {
    "q_log_events": _BASE + " SELECT file, line_no, kind, stamp, n_lines::INTEGER AS n_lines, md5(body) AS digest FROM ev",
    "q_log_signatures": _FULL + " SELECT * FROM agg",
    "q_log_files": _FULL + " SELECT hash, file, count(*) AS events FROM sig GROUP BY hash, file",
    "q_log_samples": _FULL + r""" SELECT hash, sample, file, line_no, md5(CASE WHEN length(t) > 600 THEN substr(t, 1, 600) || '...' ELSE t END) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY file, line_no) AS sample,
  trim(regexp_replace(replace(body, chr(10), ' | '), '''[^'']{0,400}''', '''<val>''', 'g')) AS t FROM sig) WHERE sample <= 2""",
    "q_log_top": _FULL + " SELECT hash, count, exception FROM agg ORDER BY count DESC, hash LIMIT 30",
    "q_log_summary": _CAPPED + """ SELECT count(*) AS total_events, count(DISTINCT hash) AS distinct_signatures,
  'mixto (' || string_agg(DISTINCT kind, ', ' ORDER BY kind) || ')' AS format_detected, count(DISTINCT hash) > 30 AS truncated,
  (SELECT count(DISTINCT file) FROM lines) AS files_scanned, (SELECT count(*) FROM lines) AS lines_scanned, (SELECT bool_or(used + n > cap) FROM used WHERE used < cap) AS scan_truncated FROM sig""",
    "q_log_levels_since": "WITH " + _head_sql("'ERROR', 'FATAL', 'WARN', 'WARNING', 'INFO'", "2024-01-15 00:00:00")
                          + " SELECT file, kind, count(*) AS events, sum(n_lines)::BIGINT AS lines FROM ev GROUP BY ALL",
    "q_log_new": _FULL + " SELECT hash, count, NOT starts_with(exception, 'COD') AS is_new FROM agg",
    "q_log_triage": _FULL + """ SELECT hash, CASE WHEN starts_with(exception, 'ORA-') THEN 'data'
  WHEN regexp_matches(exception || ' ' || message, 'NullReference|InvalidCast') THEN 'code' WHEN starts_with(exception, 'COD') THEN 'config' ELSE 'infra' END AS category,
  count * CASE WHEN starts_with(exception, 'ORA-') THEN 2 WHEN regexp_matches(exception || ' ' || message, 'NullReference|InvalidCast') THEN 3
  WHEN starts_with(exception, 'COD') THEN 2 ELSE 1 END AS priority FROM agg""",
    "q_log_recount": _BASE + """ SELECT l.file, l.n AS lines, coalesce(e.n, 0) AS events, l.n >= 100 AND l.n > coalesce(e.n, 0) * 4 AS doubtful
FROM (SELECT file, max(line_no) AS n FROM lines GROUP BY file) l LEFT JOIN (SELECT file, count(*) AS n FROM ev GROUP BY file) e USING (file)""",
    "q_line_cap_tied": f"""WITH {LINES_SQL}, f AS (SELECT file, count(*) AS n FROM lines GROUP BY file),
u AS (SELECT *, coalesce(sum(n) OVER (ORDER BY md5(file), file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, (SELECT count(*) // 2 FROM lines) AS cap FROM f)
SELECT file, least(n, cap - used)::BIGINT AS lines, used + n > cap AS scan_truncated FROM u WHERE used < cap""",
    "q_line_cap": f"""WITH {LINES_SQL}, f AS (SELECT file, count(*) AS n, substr(file, 4)::BIGINT AS id FROM lines GROUP BY file),
u AS (SELECT *, coalesce(sum(n) OVER (ORDER BY id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  (SELECT count(*) // 2 FROM lines) AS cap FROM f)
SELECT file, least(n, cap - used)::BIGINT AS lines, used + n > cap AS scan_truncated FROM u WHERE used < cap""",
}
