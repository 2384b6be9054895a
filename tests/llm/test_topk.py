import math
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tamiz.llm import topk as T


def brute(rows, k, scale=256, step=5):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in fine if i % step == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def rows_of(kind):
    rng = random.Random(kind)
    draw = {"normal": lambda: rng.gauss(0, 1), "negative": lambda: -abs(rng.gauss(0, 1)), "ties": lambda: rng.choice([0.0, 1.0]), "huge": lambda: rng.choice([1e6, -3e6, 2.5])}[kind]
    return [(k, [float(draw()) for _ in range(8)]) for k in range(90)]


@pytest.mark.parametrize("kind", ["normal", "negative", "ties", "huge"])
@pytest.mark.parametrize("k,chunk", [(5, 4096), (3, 7), (200, 16)])
def test_equals_brute_force(spark, kind, k, chunk):
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = T.top_k(df, F.col("id") % 5 == 0, k, chunk_rows=chunk)
    assert sorted(map(tuple, got.collect())) == brute(rows, k)


def test_edges(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (5, None), (10, [1.0, None, 2.0]), (15, [float("nan"), 1.0, 1.0]), (20, [float("inf"), 0.0, 1.0]), (None, [1.0, 1.0, 1.0]),
            (25, [1.0, 2.0]), (30, []), (1, [0.5, 0.5, 0.5]), (2, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("score", F.lit("x")).withColumn("block", F.lit(3))
    assert sorted(map(tuple, T.top_k(df, F.col("id") % 5 == 0, 2).collect())) == brute(rows, 2)
    assert T.top_k(df.limit(0), F.col("id") % 5 == 0).count() == 0
    assert T.top_k(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("cell_bytes,blocks", [(300, 4), (1000, 3), (1 << 20, 1)])
def test_grid_of_many_cells(spark, cell_bytes, blocks):
    """Vectors of several lengths and sizes (floats, doubles and integers are scored), repeated rows, ids in no order, ties over cells."""
    rng = random.Random(cell_bytes)
    rows = [(k, [float(rng.choice([0.5, 1.0, -1.0])) * rng.choice([1, 1, 1, 3e3, 1e6]) for _ in range(rng.choice([0, 3, 6, 6]))]) for k in range(120)]
    rows += rows[:30] + [(1000 + k, [1.0] * 6) for k in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = T.top_k(df, F.col("id") % 5 == 0, 5, chunk_rows=8, blocks=blocks, cell_bytes=cell_bytes)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


PEAK = """
import resource, sys
sys.path.insert(0, sys.argv[1])
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F
from tamiz.llm import topk as T
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", sys.argv[2]).config("spark.sql.warehouse.dir", sys.argv[3]).getOrCreate())
rows = spark.range(0, 16384, 1, 2).select(F.col("id").alias("vec_id"), F.array(*[(F.pmod(F.xxhash64("id", F.lit(j)), F.lit(513)) - 256) / 2048 for j in range(16)]).alias("embedding"))
assert T.top_k(rows, F.col("id") % 4 == 0).count() == 5 * 4096

def peak(batches):
    for _ in batches:
        pass
    yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss])], names=["kb"])

print("PEAK", spark.range(0, 64, 1, 8).mapInArrow(peak, "kb long").agg(F.max("kb")).first()[0] // 1024)
"""


def test_memory_of_a_full_query_block(tmp_path):
    """4,096 queries meet full chunks; a worker needed about 900 MB for whole matrices of scores."""
    root = str(Path(T.__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", PEAK, root, str(tmp_path / "c"), str(tmp_path / "w")], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": root})
    assert "PEAK" in done.stdout, done.stderr[-2000:]
    assert int(done.stdout.split("PEAK")[1]) < 400
