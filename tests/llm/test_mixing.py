import random

import pytest
from pyspark.sql import functions as F

from tamiz.llm import mixing as M


def water_fill(sizes, weights, budget, most):
    """Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = budget * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        room = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / room for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        full |= over


def corpus(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(900):
        source = rng.choice(["a", "a", "a", "b", "c", "dé", "Z", None])
        rows.append((k, " ".join(["w"] * int(rng.expovariate(1 / 40))), source))
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), rows


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_are_met(spark, seed):
    docs, rows = corpus(spark, seed)
    got = M.mix(docs).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = water_fill(sizes, (5, 2, 1), 1.5, 2)
    taken = {}
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and 0 <= r["copies"] <= 2 and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9) and abs(r["copies"] - r["rate"]) < 1 + 1e-9
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    for source, target in want.items():
        assert taken[source] == pytest.approx(target, rel=0.003, abs=3)


def test_rates_solve_the_dual(spark):
    """Rates are the exponential tilt of one multiplier for each source, and meet the word constraint."""
    import math
    got = M.mix(corpus(spark, 3)[0]).where("size > 0").collect()
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert sum(r["rate"] * r["size"] for r in mine) == pytest.approx(mine[0]["target"], rel=1e-6)
        inner = [math.log(r["rate"]) / r["size"] for r in mine if r["rate"] < 2 - 1e-9]
        assert not inner or max(inner) - min(inner) < 1e-9


def test_reruns_agree(spark):
    docs = corpus(spark, 4)[0]
    assert sorted(map(tuple, M.mix(docs).collect()), key=str) == sorted(map(tuple, M.mix(docs.repartition(7)).collect()), key=str)


def test_a_common_size_is_spread_and_exact(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 10 < 7, "x").otherwise("y").alias("source"))
    got = M.mix(docs, weights=(1, 2))
    rows = {r["source"]: (r["t"], r["target"]) for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("target")).collect()}
    assert all(abs(t - target) <= 3 for t, target in rows.values())


def test_word_count_is_the_patterns(spark):
    texts = [None, "", " ", "a\x0bb\x0cc\rd\ne\tf g", "\x1ca b c", "é 汉字 "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.word_count(F.col("t"))).collect()]
    assert got == [0, 0, 0, 7, 2, 2]


def test_edges(edge_docs, edge_rows, no_docs):
    got = M.mix(edge_docs).collect()
    assert len(got) == len(edge_rows) and all(r["copies"] <= 2 for r in got)
    mixed = M.mixed_documents(edge_docs)
    assert mixed.columns == edge_docs.columns and mixed.count() > 0
    assert M.mix(no_docs).count() == 0 and M.mixed_documents(no_docs).count() == 0
    assert M.mix(edge_docs.where("doc_id IN (1, 2, 3)")).agg(F.sum("size")).first()[0] == 0
