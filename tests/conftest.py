import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tamiz-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
               .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over literal text."""
    def value(make, *texts):
        from pyspark.sql import functions as F
        names = [f"v{i}" for i in range(len(texts))]
        df = spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names))
        return df.select(make(*[F.col(n) for n in names]).alias("r")).first()["r"]
    return value
