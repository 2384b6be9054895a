"""Shared pieces of the registered queries: table views, derived inputs and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.session import local_rows, table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
DEMO_KEY = b"demonstration-key-of-the-queries"

CATALOG_SCHEMA = ("table string, column string, type string, nullable boolean, pk_flag boolean, "
                  "pk_pos int, fk boolean, pii boolean, safe boolean")


def catalog_of(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Catalog columns read from the table files themselves."""
    rows = []
    for name in names:
        for f in table(spark, folder, name).schema.fields:
            rows.append((name.upper(), f.name.upper(), f.dataType.simpleString().upper(),
                         True, None, None, None, None, None))
    return local_rows(spark, rows, CATALOG_SCHEMA)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents for work on their whole texts."""
    return table(spark, folder, "documents")


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document: ``(file, line_no, text)``."""
    docs = documents(spark, folder)
    split = docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file"),
                        F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return split.select("file", (F.col("pos") + 1).cast("bigint").alias("line_no"), "text")


LINES_SQL = """lines AS (SELECT 'doc' || doc_id AS file, unnest(parts) AS text,
  unnest(range(1, len(parts) + 1)) AS line_no
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""


def hmac_sql(message: str, key: bytes) -> str:
    """HMAC-SHA256 of a SQL text expression, as hexadecimal SQL."""
    from tamiz.functions.personal import _pads
    inner, outer = _pads(key)
    lit = lambda b: f"from_hex('{b.hex()}')"
    return f"sha256({lit(outer)} || unhex(sha256({lit(inner)} || encode({message}))))"
