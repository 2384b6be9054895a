"""Read-only SQL with a row cap and masking."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import sqltext as S
from tamiz.operators.lineage import lineage
from tamiz.operators.personal import MaskReport, Policy, mask
from tamiz.session import durable


class RefusedQuery(ValueError):
    """The statement is not a single read-only query."""


def classify_sql(statements: DataFrame, column: str = "sql") -> DataFrame:
    """Add ``readonly`` and ``reason`` to a table of statements."""
    reason = S.readonly_reason(F.col(column))
    return statements.withColumn("reason", reason).withColumn("readonly", F.col("reason").isNull())


def guarded_query(spark: SparkSession, sql: str, catalog: DataFrame, policy: Policy, key: bytes,
                  max_rows: int | None = 200) -> tuple[DataFrame, MaskReport]:
    """Run one SELECT, keep at most ``max_rows`` rows, mask them and report.

    The analysed plan tells which tables are read and which of their columns each output column is made of: one masked origin
    masks the output, whatever it is called, unless only a count of it is left. The output's own name is judged too, against the
    tables that the plan reads and those that the text names. Files that no catalog table or view names are refused. When rows are
    read but no table can be told, every column is masked. The result is written out before it is scanned, so the rows that are
    judged are the rows that are returned, and the query runs once. When masking fails no row is returned.
    """
    text = F.lit(sql)
    seen = spark.range(1).select(S.readonly_reason(text).alias("reason"), S.sql_tables(text, spark=True).alias("tables"),
                                 S.sql_predicates(text, spark=True).alias("predicates")).first()
    if seen["reason"] is not None:
        raise RefusedQuery(seen["reason"])
    result = spark.sql(sql)  # analysed, not run
    known = lineage(result)
    if known.files:
        raise RefusedQuery(S.READS_PATH)
    read = [*[t for t in seen["tables"] if t in known.tables], *[t for t in known.tables if t not in seen["tables"]]]
    tables = list(dict.fromkeys([*seen["tables"], *read]))
    if known.reads and not tables:
        policy = replace(policy, patterns=("*",))
    count = truncated = None
    if max_rows is None:
        result = durable(result)
    else:
        capped = durable(result.limit(max_rows + 1))
        total = capped.count()
        count, truncated = min(total, max_rows), total > max_rows
        result = durable(capped.limit(max_rows)) if truncated else capped
    try:
        masked, report = mask(result, tables, catalog, policy, key, seen["predicates"], known.origins)
    except Exception as problem:  # fail closed whatever went wrong
        report = MaskReport(policy.mode, tables=tables, error=type(problem).__name__)
        return result.limit(0), report
    report.tables = read
    report.row_count, report.rows_truncated = count, truncated
    return masked, report
