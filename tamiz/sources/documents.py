"""Document sources: error and test-result XML, catalog and history JSON, table dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V
from tamiz.functions import logtext as L


def _detail(most: int | None):
    lines = F.split("_detail", "\n")
    return lines if most is None else F.slice(lines, F.lit(1), F.lit(most))


def read_error_xml(spark: SparkSession, path: str, most_lines: int | None = V.XML_DETAIL_LINES) -> DataFrame:
    """One log event per ``<error>``: type and message, then the first ``most_lines`` lines of the detail, None for all."""
    schema = "_time string, _type string, _message string, _detail string"
    rows = spark.read.format("xml").option("rowTag", "error").option("ignoreCorruptFiles", "true").schema(schema).load(path)
    head = F.concat(F.coalesce("_type", F.lit("")), F.lit(": "), F.coalesce("_message", F.lit("")))
    detail = _detail(most_lines)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.lit(0).cast("bigint").alias("line_no"),
                       F.lit(L.XML).alias("kind"), F.coalesce("_time", F.lit("")).alias("stamp"),
                       F.concat(F.array(head), F.coalesce(detail, F.array().cast("array<string>"))).alias("lines"))


def parse_error_xml(texts: DataFrame, column: str = "value", keep: tuple[str, ...] = (), most_lines: int | None = V.XML_DETAIL_LINES) -> DataFrame:
    """Log events of whole ``<error>`` documents in a text column, with the first ``most_lines`` lines of the detail, None for all;
    what is no such document gives no event."""
    schema = "_time string, _type string, _message string, _detail string"
    doc = F.from_xml(F.col(column), schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = texts.select(*keep, doc.alias("e")).where("e._bad IS NULL AND e IS NOT NULL").select(*keep, "e.*")
    head = F.concat(F.coalesce("_type", F.lit("")), F.lit(": "), F.coalesce("_message", F.lit("")))
    detail = _detail(most_lines)
    return rows.select(*keep, F.lit(L.XML).alias("kind"), F.coalesce("_time", F.lit("")).alias("stamp"),
                       F.concat(F.array(head), F.coalesce(detail, F.array().cast("array<string>"))).alias("lines"))


COUNTERS = ["total", "executed", "passed", "failed", "error", "timeout", "aborted", "notExecuted", "inconclusive"]


def parse_test_results(texts: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Counters and single results of whole result documents in a text column. A cut-off document has neither."""
    result = "_testName: string, _outcome: string, Output: struct<ErrorInfo: struct<Message: string, StackTrace: string>>"
    schema = (f"ResultSummary struct<Counters: struct<{', '.join(f'_{n}: bigint' for n in COUNTERS)}>>, "
              f"Results struct<UnitTestResult: array<struct<{result}>>>, _bad string")
    doc = F.from_xml(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    whole = texts.select(*keep, doc.alias("d")).where("d._bad IS NULL AND d.ResultSummary.Counters IS NOT NULL")
    counters = whole.select(*keep, *[F.col(f"d.ResultSummary.Counters._{n}").alias(n) for n in COUNTERS])
    results = whole.select(*keep, F.explode("d.Results.UnitTestResult").alias("r")).select(
        *keep, F.col("r._testName").alias("testName"), F.col("r._outcome").alias("outcome"),
        F.col("r.Output.ErrorInfo.Message").alias("message"), F.col("r.Output.ErrorInfo.StackTrace").alias("stack"))
    return counters, results


def read_test_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Counters and single results of test-result files; a cut-off file is not among them."""
    names = COUNTERS
    xml = lambda tag, schema: (spark.read.format("xml").option("rowTag", tag).option("mode", "DROPMALFORMED")
                               .option("ignoreCorruptFiles", "true").schema(schema).load(path))
    counters = xml("Counters", ", ".join(f"_{n} bigint" for n in names)).select(
        F.col("_metadata.file_path").alias("file"), *[F.col(f"_{n}").alias(n) for n in names])
    results = xml("UnitTestResult", "_testName string, _outcome string, "
                  "Output struct<ErrorInfo: struct<Message: string, StackTrace: string>>").select(
        F.col("_metadata.file_path").alias("file"), F.col("_testName").alias("testName"), F.col("_outcome").alias("outcome"),
        F.col("Output.ErrorInfo.Message").alias("message"), F.col("Output.ErrorInfo.StackTrace").alias("stack"))
    # A cut-off file has lost its counters; what is left of its results is not a result of the run.
    return counters, results.join(counters.select("file").distinct(), "file", "left_semi")


_CATALOG_SQL = """
WITH doc AS (SELECT parse_json(regexp_replace(value, '^\\\\uFEFF', '')) AS d FROM {texts}),
checked AS (SELECT CASE WHEN schema_of_variant(d) LIKE 'OBJECT%' THEN d
    ELSE CAST(raise_error('the root of a catalog must be an object') AS VARIANT) END AS d FROM doc),
tabs AS (SELECT upper(coalesce(t.key, try_variant_get(t.value, '$.name', 'string'),
    try_variant_get(t.value, '$.tableName', 'string'), '?')) AS `table`, t.value AS v
  FROM checked, LATERAL variant_explode(variant_get(d, '$.tables', 'variant')) AS t
  WHERE schema_of_variant(t.value) LIKE 'OBJECT%')
SELECT `table`, upper(coalesce(c.key, try_variant_get(c.value, '$.name', 'string'),
    try_variant_get(c.value, '$.columnName', 'string'), '?')) AS `column`,
  try_variant_get(c.value, '$.type', 'string') AS type, try_variant_get(c.value, '$.nullable', 'boolean') AS nullable,
  CASE WHEN schema_of_variant(try_variant_get(c.value, '$.pk', 'variant')) = 'BOOLEAN' THEN try_variant_get(c.value, '$.pk', 'boolean') END AS pk_flag,
  CASE WHEN schema_of_variant(try_variant_get(c.value, '$.pk', 'variant')) <> 'BOOLEAN' THEN try_variant_get(c.value, '$.pk', 'int') END AS pk_pos,
  schema_of_variant(try_variant_get(c.value, '$.fk', 'variant')) NOT IN ('VOID') AND coalesce(try_variant_get(c.value, '$.fk', 'boolean'), true) AS fk,
  try_variant_get(c.value, '$.pii', 'boolean') AS pii, try_variant_get(c.value, '$.safe', 'boolean') AS safe,
  try_variant_get(c.value, '$.description', 'string') AS description
FROM tabs, LATERAL variant_explode(variant_get(v, '$.columns', 'variant')) AS c
WHERE schema_of_variant(c.value) LIKE 'OBJECT%'"""


def parse_catalog(texts: DataFrame) -> DataFrame:
    """Catalog columns of JSON documents in the column ``value``; tables and columns may be objects or lists. Marks that are
    absent stay NULL."""
    return texts.sparkSession.sql(_CATALOG_SQL, texts=texts)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return parse_catalog(spark.read.option("wholetext", "true").text(path))


HISTORY = "id string, timestamp string, solution string, workspace string, task string, status string, agents array<string>"


def parse_history(texts: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Runs of whole history texts: a JSON array, or one JSON object a line. A broken array gives no run, a broken line is left
    out, and so is a run without an id. ``version`` is null but in files of ``append_history``."""
    row = HISTORY + ", version bigint"
    body = F.regexp_replace(F.col(column), r"^[\uFEFF\s]+", "")
    lines = F.filter(F.split(body, r"\r?\n"), lambda t: F.trim(t) != "")
    runs = F.when(body.startswith("["), F.from_json(body, f"array<struct<{row.replace(' ', ':').replace(',:', ',')}>>")).otherwise(
        F.transform(lines, lambda t: F.from_json(t, row)))
    return texts.select(*keep, F.explode(runs).alias("r")).where("r.id IS NOT NULL").select(*keep, "r.*")


def history_rows(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException
    try:
        texts = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").text(path)
    except AnalysisException:
        return spark.createDataFrame([], HISTORY + ", version bigint")
    return parse_history(texts)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Run history of a file or folder; a missing or broken file is an empty history. Of a folder with versions, the newest."""
    rows = history_rows(spark, path)
    top = rows.agg(F.max("version")).first()[0]
    return (rows if top is None else rows.where(F.col("version") == top)).drop("version")


def read_dictionary(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Columns of the session catalog as dictionary rows."""
    rows = []
    for t in spark.catalog.listTables(database):
        for i, c in enumerate(spark.catalog.listColumns(t.name, database) if not t.isTemporary else spark.catalog.listColumns(t.name)):
            rows.append((t.name.upper(), c.name.upper(), i + 1, c.dataType.upper(), c.nullable))
    from tamiz.session import local_rows
    return local_rows(spark, rows, "table string, column string, ord int, type string, nullable boolean")


def read_dictionary_jdbc(spark: SparkSession, url: str, schema: str, properties: dict | None = None) -> dict[str, DataFrame]:
    """Dictionary tables of an Oracle schema over JDBC: columns, constraints, checks, indexes. The
    driver is the caller's; reads are pushed down as queries on the owner."""
    owner = schema.upper().replace("'", "''")
    base = spark.read.format("jdbc").option("url", url).options(**(properties or {}))
    ask = lambda q: base.option("query", q).load()
    cons = ask("SELECT c.CONSTRAINT_TYPE kind, c.TABLE_NAME, c.CONSTRAINT_NAME, k.COLUMN_NAME, k.POSITION, c.R_CONSTRAINT_NAME, c.DELETE_RULE "
               f"FROM ALL_CONSTRAINTS c JOIN ALL_CONS_COLUMNS k ON k.OWNER = c.OWNER AND k.CONSTRAINT_NAME = c.CONSTRAINT_NAME WHERE c.OWNER = '{owner}'")
    return {
        "columns": ask("SELECT TABLE_NAME, COLUMN_NAME, COLUMN_ID, DATA_TYPE, DATA_LENGTH, CHAR_LENGTH, DATA_PRECISION, DATA_SCALE, NULLABLE, CHAR_USED "
                       f"FROM ALL_TAB_COLUMNS WHERE OWNER = '{owner}'"),
        "constraints": cons,
        "checks": ask(f"SELECT TABLE_NAME, CONSTRAINT_NAME, SEARCH_CONDITION_VC condition FROM ALL_CONSTRAINTS WHERE OWNER = '{owner}' AND CONSTRAINT_TYPE = 'C'"),
        "indexes": ask("SELECT i.TABLE_NAME, i.INDEX_NAME, i.UNIQUENESS, c.COLUMN_NAME, c.COLUMN_POSITION, c.DESCEND FROM ALL_INDEXES i JOIN ALL_IND_COLUMNS c "
                       f"ON c.INDEX_OWNER = i.OWNER AND c.INDEX_NAME = i.INDEX_NAME WHERE i.OWNER = '{owner}'"),
    }


def indexes_without_constraint(indexes: DataFrame, constraints: DataFrame) -> DataFrame:
    """Indexes that do not merely back a key or unique constraint."""
    backing = constraints.where(F.col("kind").isin("P", "U")).select("table", "name").distinct()
    return indexes.join(backing, ["table", "name"], "left_anti")
