"""SQL in program text: the string literals of source files, also those over several lines, and the statements built from them.

A line either starts in code or inside a verbatim literal that an earlier line opened. What a line does to that state is one of
three things: it fixes it, keeps it or turns it over. So the state before a line is the one fixed last, turned over as often as
lines since then do so: a last value and a running count, which `ordered` scans without putting a file on one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V
from tamiz.functions.sqltext import NAME, base_name
from tamiz.operators.ordered import running, running_sum
from tamiz.session import durable

_CALL = r"\.\s*Append(?:Line|Format)?\s*\(\s*"
_VERBATIM_MARK = r"(?:@\$?|\$@)\""
_PAIRS = r"[^\"]*+(?:\"\"[^\"]*+)*+"
_ESCAPES = r"[^\"\\]*+(?:\\.[^\"\\]*+)*+\\?+"
# A literal with the append call it is handed to, a character, or a comment up to the end of its line.
_TOKEN = rf"(?:{_CALL})?(?:{_VERBATIM_MARK}{_PAIRS}(?:\"|\z)|\$?\"{_ESCAPES}(?:\"|\z))|'(?:\\.[^']*|[^'\\])'|//.*"
_STILL_OPEN = rf"^(?:{_CALL})?{_VERBATIM_MARK}{_PAIRS}\z"
_CLOSES = rf"^{_PAIRS}\""
_LITERAL = rf"^(?:{_CALL})?[$@]*\""
_BODY = rf"^(?:{_CALL})?(?:{_VERBATIM_MARK}({_PAIRS})|\$?\"({_ESCAPES}))"
_BUILDER = r"\bnew\s+StringBuilder\b"
#: Place in its line of a literal that goes on in the next line; nothing can follow it.
_TAIL = 2147483647


def _tokens(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(_TOKEN), F.lit(0))


def _left_open(code: Column) -> Column:
    return F.coalesce(F.get(F.slice(_tokens(code), -1, 1), F.lit(0)).rlike(_STILL_OPEN), F.lit(False))


def _inside(lines: DataFrame) -> DataFrame:
    """``(file, line_no)`` of the lines that start inside a literal."""
    closes = F.col("text").rlike(_CLOSES)
    effect = lines.select("file", "line_no", _left_open(F.col("text")).alias("from_code"),
                          (~closes | _left_open(F.regexp_replace("text", _CLOSES, ""))).alias("from_literal"))
    facts = durable(effect.select("file", "line_no", F.when(F.col("from_code") == F.col("from_literal"), F.col("from_code").cast("long")).alias("fixed"),
                                  (F.col("from_code") & ~F.col("from_literal")).cast("long").alias("turn")))
    turned = durable(running_sum(facts, ["file"], "line_no", F.col("turn"), "turns"))
    state = running(turned, ["file"], "line_no", {"start": (F.col("fixed") + F.col("turns"), "last")}, exclusive=True)
    return state.where((F.coalesce("start", F.lit(0)) + F.col("turns") - F.col("turn")) % 2 == 1).select("file", "line_no", F.lit(True).alias("inside"))


def source_literals(lines: DataFrame) -> DataFrame:
    """String literals of ``lines(file, line_no, text)``: ``(file, line_no, pos, text, appended, builder)``.

    Plain, verbatim and interpolated literals, verbatim ones over any number of lines, with doubled or escaped quotes made single.
    ``appended`` tells that a literal is handed to an append call, ``builder`` the line of the last new builder of the file. Quotes in
    line comments and character literals open nothing. ``line_no`` is a whole number, unique in its file; a null text is an empty line."""
    lines = lines.select("file", F.col("line_no").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    starts = F.coalesce("inside", F.lit(False))
    closes = F.col("text").rlike(_CLOSES)
    code = F.when(~starts, F.col("text")).when(closes, F.regexp_replace("text", _CLOSES, "")).otherwise("")
    marked = lines.join(_inside(lines), ["file", "line_no"], "left").select("file", "line_no", starts.alias("inside"), code.alias("code"), F.when(
        starts, F.regexp_extract("text", f"^({_PAIRS})", 1)).alias("head"))
    bare = F.regexp_replace("code", _TOKEN, '""')
    found = durable(marked.select(
        "file", "line_no", "inside", "head", _tokens(F.col("code")).alias("tokens"), _left_open(F.col("code")).alias("open"),
        F.col("code").rlike(r"^\s*[$@]*\"").alias("leads"), F.when(bare.rlike(_BUILDER), F.col("line_no")).alias("own"),
        F.when(F.trim(bare) != "", bare.rlike(rf"{_CALL}$")).alias("pends")).where("inside OR size(tokens) > 0 OR own IS NOT NULL OR pends IS NOT NULL"))
    known = running(found, ["file"], "line_no", {
        "opened": (F.when(F.col("open"), F.col("line_no")), "last"), "built": (F.col("own"), "last"), "pending": (F.col("pends"), "last")}, exclusive=True)
    builder = F.coalesce("own", "built")
    called = lambda t, i: t.rlike(f"^{_CALL}") | ((i == 0) & F.col("leads") & F.coalesce("pending", F.lit(False)))
    body = lambda t: F.concat(F.regexp_extract(t, _BODY, 1), F.regexp_extract(t, _BODY, 2))
    piece = lambda at, pos, text, verbatim, call, made: F.struct(
        at.alias("at"), pos.alias("pos"), text.alias("text"), verbatim.alias("verbatim"), call.alias("appended"), made.alias("builder"))
    pieces = F.transform("tokens", lambda t, i: F.when(t.rlike(_LITERAL), piece(
        F.col("line_no"), F.when(t.rlike(_STILL_OPEN), F.lit(_TAIL)).otherwise(i),
        body(t),
        t.rlike(rf"^(?:{_CALL})?{_VERBATIM_MARK}"), called(t, i), builder)))
    head = F.when(F.col("inside"), piece(F.col("opened"), F.lit(_TAIL), F.col("head"), F.lit(True), F.lit(False), F.lit(None).cast("long")))
    rows = known.select("file", "line_no", F.explode(F.filter(F.concat(F.array(head), pieces), lambda p: p.isNotNull())).alias("p")).select("file", "line_no", "p.*")
    whole = rows.groupBy("file", "at", "pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.bool_or("verbatim").alias("verbatim"), F.bool_or("appended").alias("appended"), F.max("builder").alias("builder"))
    text = F.when(F.col("verbatim"), F.replace("text", F.lit('""'), F.lit('"'))).otherwise(F.replace("text", F.lit('\\"'), F.lit('"')))
    return whole.select("file", F.col("at").alias("line_no"), "pos", text.alias("text"), "appended", "builder")


def source_statements(lines: DataFrame) -> DataFrame:
    """SQL of source files: ``(file, line_no, kind, sql)``. ``literal``: a literal that holds a SQL word; ``builder``: what is
    appended to one builder, joined by blanks. A literal that is appended counts as both."""
    literals = durable(source_literals(lines))
    words = lambda of: rf"(?i)\b({'|'.join(of)})\b"
    single = literals.where(F.col("text").rlike(words(V.SOURCE_SQL_WORDS))).select("file", "line_no", F.lit("literal").alias("kind"), F.col("text").alias("sql"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "pos", "text")))
    built = literals.where("appended AND builder IS NOT NULL").groupBy("file", "builder").agg(parts.alias("parts")).select(
        "file", F.get("parts", F.lit(0))["line_no"].alias("line_no"), F.lit("builder").alias("kind"), F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("sql"))
    return single.unionByName(built.where(F.col("sql").rlike(words(V.BUILDER_SQL_WORDS))))


def named_tables(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """Tables that statements read or write: ``(table, statements)``, upper case and without their schema."""
    names = F.regexp_extract_all(F.col(sql), F.lit(rf"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+({NAME})"), F.lit(1))
    each = statements.select(F.explode(F.array_distinct(F.transform(names, base_name))).alias("table"))
    return each.where(~F.col("table").isin(V.SQL_WORDS)).groupBy("table").agg(F.count("*").alias("statements"))
