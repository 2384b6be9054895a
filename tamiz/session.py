"""Session helpers: reading the table folder, durable lineage cuts, bounded driver reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, MapType, NullType, StructType, VariantType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. A local session, one process, may go without:
    it gets a folder of its own that goes when the process ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="tamiz-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _plain(kind: DataType) -> bool:
    """Whether Parquet holds the type as it is."""
    if isinstance(kind, StructType):
        return all(_plain(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _plain(kind.elementType)
    if isinstance(kind, MapType):
        return _plain(kind.keyType) and _plain(kind.valueType)
    return not isinstance(kind, (NullType, VariantType)) and "interval" not in kind.simpleString()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing the rows to the shared folder, once, where lost executors cannot take them along. Columns are
    stored by place, so a name may come twice; later reads take only the columns they need."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not df.columns or not _plain(df.schema):
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return df.checkpoint(eager=True)
    placed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    path = f"{folder}/table-{uuid.uuid4().hex}"
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path).toDF(*df.columns)


def bounded_rows(df: DataFrame, most: int) -> list:
    """Bring a small lookup table to the driver, refusing it when it is not small."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"lookup table has more than {most} rows")
    return rows


def local_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A short list of rows as a local relation, whose size the optimizer knows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)
