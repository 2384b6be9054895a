"""Where intermediate tables go: the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session, where driver and executors are one process, may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tamiz-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc32_of_id(column: str = "doc_id"):
    """CRC-32 of the id written as text; 0 bytes for a null id."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Lower the session's Arrow batches to ``rows`` rows and about ``size`` bytes where they are larger: a batch lies in the JVM and in the
    worker at once. One row is never cut, whatever its size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(name).strip().lower()).groups()
    if not 0 < int(digits) << 10 * " kmgt".index(unit or " ") <= size:
        spark.conf.set(name, size)
