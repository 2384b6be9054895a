"""Column expressions that read SQL text: read-only gate, tables in scope, filtered columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V
from tamiz.functions.personal import bind

_LITERAL = r"'[^']*+(?:''[^']*+)*+(?:'|\z)"
_COMMENT = r"--[^\n]*|/\*(?s:.*?)(?:\*/|\z)"
_MARK = "\u0001"
NAME = V.SQL_NAME
WORD = r"[A-Za-z_][\w$#]*"
_LIST = rf"(?i)\b(?:FROM|JOIN)\s+({NAME}(?:\s*(?:(?:AS\s+)?[A-Za-z_][\w$#]*)?\s*,\s*{NAME})*)"
_FILTERED = "(?i)" + V.SQL_FILTERED

ONLY_SELECT = "only SELECT or WITH ... SELECT is allowed"
WRITE_IN_CTE = "write verb inside WITH is not allowed"
MULTI_STATEMENT = "several statements are not allowed"
CALLS_JAVA = "functions that call into the JVM are not allowed"
READS_PATH = "reading a path past the catalog is not allowed"

# Quoted texts and comments of Spark SQL: single and double quotes with backslash escapes; a back-quoted name is kept.
_SPARK_TEXT = r"(`[^`]*+`)|'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\"|--[^\n]*|/\*(?s:.*?)(?:\*/|\z)"
_JVM_CALL = r"(?i)(?<![\w`])`?(?:reflect|java_method|try_reflect)`?\s*\("
_FORMAT = r"`?(?:parquet|orc|json|csv|text|avro|xml|binaryfile|delta|iceberg|hudi|jdbc)`?\s*\.\s*`"
# Behind FROM or JOIN, or behind a comma of the list that FROM begins.
_PATH_RELATION = rf"(?is)\b(?:FROM|JOIN)\s*\(*\s*{_FORMAT}|\bFROM\b(?:(?!\b(?:SELECT|WHERE|GROUP|ORDER|HAVING|LIMIT|UNION|INTERSECT|EXCEPT|WINDOW)\b).)*?,\s*(?:LATERAL\s+)?\(*\s*{_FORMAT}"


def strip_comments(col: Column) -> Column:
    """Comments to one blank each; quoted literals stay as they are."""
    marked = F.regexp_replace(col, f"({_LITERAL})|{_COMMENT}", f"$1{_MARK}")
    return F.translate(F.replace(marked, F.lit("'" + _MARK), F.lit("'")), _MARK, " ")


def has_open_literal(col: Column) -> Column:
    return F.regexp_replace(col, r"'[^']*+(?:''[^']*+)*+'", "").contains("'")


def blank_literals(col: Column) -> Column:
    return F.regexp_replace(col, r"'[^']*'", "'?'")


def spark_text(col: Column) -> Column:
    """A Spark statement as plain text: comments and quoted texts are blanks, back-quotes are off, brackets around a relation
    too, and a name keeps its last two parts. A quote that is still open stays."""
    bare = F.translate(F.regexp_replace(col, _SPARK_TEXT, "$1 "), "`", "")
    opened = F.regexp_replace(bare, r"(?i)\b(FROM|JOIN)\s*\(+\s*(?!(?:SELECT|WITH|VALUES|FROM|TABLE)\b)", "$1 ")
    return F.regexp_replace(opened, r"(?<![\w.])[A-Za-z_][\w$#]*\s*\.\s*(?=[A-Za-z_][\w$#]*\s*\.\s*[A-Za-z_])", "")


def readonly_reason(col: Column) -> Column:
    """Why a statement is refused, or NULL when it only reads. Functions that run any JVM method and relations that are file
    paths are refused too."""
    bare = lambda text: F.regexp_replace(F.rtrim(text, F.lit(";")), r"'[^']*+(?:'|\z)", "''")
    # Judged with and without quoted texts blanked, as either reading of a quote may be the engine's.
    quiet = F.regexp_replace(col, _SPARK_TEXT, "$1 ")
    either = lambda text, rx: text.rlike(rx) | quiet.rlike(rx)
    return bind(F.btrim(strip_comments(col), F.lit(" \t\r\n\f\u000b")), lambda text: (
        F.when(~text.rlike(r"(?i)^(SELECT|WITH)") | text.isNull(), F.lit(ONLY_SELECT))
        .when(text.rlike(r"(?i)^WITH") & text.rlike(r"(?i)\b(INSERT|UPDATE|DELETE|MERGE)\b"), F.lit(WRITE_IN_CTE))
        .when(bare(text).contains(";"), F.lit(MULTI_STATEMENT))
        .when(either(bare(text), _JVM_CALL), F.lit(CALLS_JAVA))
        .when(either(bare(text), _PATH_RELATION), F.lit(READS_PATH))))


def base_name(raw: Column) -> Column:
    """A table name without its schema, upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(raw, r"\s+", ""), r"^.*\.", ""))


def _list_names(item: Column) -> Column:
    names = F.transform(F.split(item, ","), lambda e: base_name(F.regexp_extract(e, f"({NAME})", 1)))
    # The first name always counts; the list ends at the first later word that is not a name.
    flags = lambda ns: F.transform(ns, lambda n, i: (i > 0) & n.isin(V.LIST_STOP_WORDS))
    cut = lambda ns: bind(F.array_position(flags(ns), True), lambda stop: F.when(
        stop > 0, F.slice(ns, F.lit(1), (stop - 1).cast("int"))).otherwise(ns))
    return bind(names, lambda ns: F.when(F.size(ns) > 1, cut(ns)).otherwise(ns))


def sql_tables(col: Column, spark: bool = False) -> Column:
    """Table names after FROM and JOIN, upper case, no schema, in order, once each. ``spark``: read the text by the rules of
    Spark SQL (back-quotes, double quotes, escapes, three-part names, bracketed relations)."""
    lists = lambda text: F.regexp_extract_all(text, F.lit(_LIST), F.lit(1))
    names = lambda text: F.array_distinct(F.flatten(F.transform(lists(text), _list_names)))
    return bind(spark_text(col) if spark else strip_comments(col), lambda text: F.when(has_open_literal(text), F.array().cast("array<string>")).otherwise(
        F.filter(names(text), lambda n: (n != "DUAL") & (n != ""))))


def sql_predicates(col: Column, spark: bool = False) -> Column:
    """Columns left of a comparator after the first WHERE, upper case, once each."""
    body = lambda text: F.regexp_extract(text, r"(?is)\bWHERE\b(.*)", 1)
    found = lambda text: F.regexp_extract_all(body(text), F.lit(_FILTERED), F.lit(1))
    return bind(spark_text(col) if spark else strip_comments(col), lambda text: F.when(has_open_literal(text), F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(found(text), lambda c: F.upper(c)))))
