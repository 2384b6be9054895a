"""Sinks: INSERT text, table exports, rotated history, partition replacement."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.functions import fixed_values as V
from tamiz.functions.personal import as_text, redact_text


def _literal(name: str, kind: T.DataType, dialect: str, large: bool) -> Column:
    col = F.col(f"`{name}`")
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    if large:
        return F.lit("NULL")
    if isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("HEXTORAW('"), F.hex(col), F.lit("')")) if dialect == "ORACLE" else F.concat(F.lit("0x"), F.hex(col))
        text = F.when(F.length(col) == 0, F.lit("NULL")).otherwise(text)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        # Every digit is kept (an exponent where the number needs one); only one dialect can write what is no number.
        odd = {"Infinity": "BINARY_DOUBLE_INFINITY", "-Infinity": "-BINARY_DOUBLE_INFINITY", "NaN": "BINARY_DOUBLE_NAN"}
        text = as_text(col, "double")
        for name, literal in odd.items():
            text = F.when(col.cast("string") == name, literal if dialect == "ORACLE" else "NULL").otherwise(text)
    elif isinstance(kind, T.NumericType):
        text = col.cast("string")
    elif isinstance(kind, T.BooleanType):
        text = col.cast("int").cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and dialect == "SQLSERVER":
        text = quoted(F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        text = quoted(F.date_format(col, "yyyy-MM-dd HH:mm:ss"))
    else:
        text = quoted(col.cast("string"))
    return F.when(col.isNull(), F.lit("NULL")).otherwise(text)


def insert_statements(df: DataFrame, table: str, dialect: str = "ORACLE", large: tuple[str, ...] = (),
                      keep: tuple = ()) -> DataFrame:
    """One INSERT per row in ``statement``, after any ``keep`` columns. NULL stays NULL and an empty
    text stays an empty text; columns named ``large`` hold binaries too big for text and become NULL."""
    names = ", ".join(df.columns)
    values = F.concat_ws(", ", *[_literal(f.name, f.dataType, dialect, f.name in large) for f in df.schema.fields])
    return df.select(*keep, F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES ("), values, F.lit(");")).alias("statement"))


def to_insert_sql(df: DataFrame, table: str, path: str, order: list[str], dialect: str = "ORACLE",
                  large: tuple[str, ...] = ()) -> None:
    """Write the INSERT script as part files that read in name order: header, rows by ``order``, end.

    Rows are range-partitioned by their order, so no part passes through one task.
    """
    keep = (F.lit(1).alias("part"), F.struct(*order).alias("k"))
    rows = insert_statements(df, table, dialect, large, keep).withColumnRenamed("statement", "value")
    head = [f"-- Inserts {table}"]
    if large:
        head.append("-- large binary columns written as NULL: " + ", ".join(large))
    if dialect == "ORACLE":
        head += ["SET DEFINE OFF;", "ALTER SESSION SET NLS_DATE_FORMAT='YYYY-MM-DD HH24:MI:SS';",
                 "ALTER SESSION SET NLS_TIMESTAMP_FORMAT='YYYY-MM-DD HH24:MI:SS';"]
    tail = ["commit;"] if dialect == "ORACLE" else []
    if df.isEmpty():
        tail.insert(0, "-- (no rows)")
    kind = rows.schema["k"].dataType.simpleString()
    edge = lambda part, texts: df.sparkSession.range(1).select(
        F.lit(part).alias("part"), F.lit(None).cast(kind).alias("k"), F.lit("\n".join(texts)).alias("value"))
    out = rows.unionByName(edge(0, head))
    if tail:
        out = out.unionByName(edge(2, tail))
    out.orderBy("part", "k").select("value").write.mode("overwrite").text(path)


def pick_tables(subset: list[str], extra: list[str], excluded: list[str], known: dict[str, bool]) -> tuple[list[str], list[tuple[str, str]]]:
    """Tables of a named subset plus extra ones minus excluded ones, in order, once each.
    ``known`` maps the catalog's tables to whether they are orphans; skipped names come with why."""
    gone, seen, out, notes = {t.upper() for t in excluded}, set(), [], []
    for name in (t.upper() for t in [*subset, *extra]):
        if name in seen or name in gone:
            continue
        seen.add(name)
        if name not in known:
            notes.append((name, "not in the catalog"))
        elif known[name]:
            notes.append((name, "orphan"))
        else:
            out.append(name)
    return out, notes


def export_tables(tables: dict[str, tuple[DataFrame, list[str]]], path: str, dialect: str = "ORACLE", parallel: int = 4) -> list[tuple[str, str, int, str]]:
    """Write every table's script as its own job, several at a time; a failing table does not stop
    the others. Gives ``(table, OK or ERROR, rows, message)``."""
    def one(item):
        name, (df, order) = item
        try:
            to_insert_sql(df, name, f"{path}/{name}", order, dialect)
            return name, "OK", df.count(), ""
        except Exception as problem:
            return name, "ERROR", 0, type(problem).__name__
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(one, tables.items()))


def split_history(df: DataFrame, keep: int = V.HISTORY_KEEP) -> tuple[DataFrame, DataFrame]:
    """Newest runs to keep and older ones for the monthly archive, task text redacted first. The
    cut is the oldest of a top-k, so the rows are not sorted as a whole."""
    clean = df.withColumn("task", redact_text(F.col("task")))
    cut = clean.select("timestamp", "id").orderBy(F.desc("timestamp"), F.desc("id")).limit(keep).agg(
        F.min(F.struct("timestamp", "id")).alias("c"), F.count("*").alias("n")).first()
    month = F.replace(F.substring("timestamp", 1, 7), F.lit("-"), F.lit(""))
    if cut["n"] < keep:
        return clean, clean.limit(0).withColumn("month", month)
    at = F.struct(F.lit(cut["c"]["timestamp"]).alias("timestamp"), F.lit(cut["c"]["id"]).alias("id"))
    newer = F.struct("timestamp", "id") >= at
    return clean.where(newer), clean.where(~newer).withColumn("month", month)


def append_history(df: DataFrame, current: str, archive: str, keep: int = V.HISTORY_KEEP) -> None:
    """Write the history: its newest runs to ``current``, older ones to ``archive`` by month.

    ``df`` may be what was read from ``current``. There are two slots; the new version goes to the slot that the readable one
    does not use, so a run that is lost on the way leaves the old version whole. The archive's rows lie under the version that
    moved them, so a repeated run writes the same rows over again. JSON lines throughout, as ``read_history`` reads them."""
    spark = df.sparkSession
    last = _history_version(spark, current)
    kept, old = split_history(df, keep)
    columns = [c for c in df.columns if c != "version"]
    (old.select(*columns, "month").withColumn("batch", F.lit(last + 1)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month", "batch").json(archive))
    kept.select(*columns).withColumn("version", F.lit(last + 1).cast("bigint")).write.mode("overwrite").json(f"{current}/slot-{(last + 1) % 2}")


def _history_version(spark, current: str) -> int:
    from tamiz.sources.documents import history_rows
    top = history_rows(spark, current).agg(F.max("version")).first()[0]
    return top or 0


def replace_partition(df: DataFrame, path: str, key: str) -> None:
    """Replace the partitions present in the frame and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
