"""Factorisation machine: the identity against all pairs, gradients by their effect, held-out accuracy, edge cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamiz.llm import machine as M
from tamiz.llm import sampling
from tamiz.session import local_rows

FOLDER = "/root/testdata/sf0.01"


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(1)
    texts = pa.array(["a b a c", "", None, "Ünï!! x x x\ny\ny", "lone"], pa.large_string())
    known = np.array([[1.0], [np.nan], [3.0], [2.0], [5.0]])
    machine = M.empty_machine(texts, known, np.array([0, 1, 1, 0, 1]))
    machine.linear = rng.normal(size=machine.linear.shape)
    machine.factors = rng.normal(size=machine.factors.shape)
    of, feature, value = machine.vectors(texts, known)
    got = machine.logits(of, feature, value, 5)
    for d in range(5):
        f, x = feature[of == d], value[of == d]
        assert len(set(f.tolist())) == len(f)
        pairs = sum(machine.factors[f[i]] @ machine.factors[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert got[d] == pytest.approx(machine.bias + machine.linear[f] @ x + pairs)


def test_statistics():
    stats, of, bucket, value = M.described(pa.array(["AB ab\nAB ab\n!!", "", None], pa.large_string()))
    row = dict(zip(M.STATISTICS, stats[0]))
    assert row["upper"] == pytest.approx(4 / 14) and row["mark"] == pytest.approx(2 / 14) and row["repeated lines"] == pytest.approx(1 / 3)
    assert row["distinct words"] == pytest.approx(1 / 4) and row["word length"] == 2 and row["commonest word"] == 1 and row["words said again"] == 3 / 4
    assert (stats[1] == stats[2]).all() and set(of.tolist()) == {0} and (value ** 2).sum() == pytest.approx(1)


def test_pairs_carry_what_no_word_does(monkeypatch):
    monkeypatch.setattr(M, "WORDS", 1.0)
    # Label 1: both words of a couple or neither; no single word tells anything.
    rng = np.random.default_rng(4)
    couples = [(f"p{k}", f"q{k}") for k in range(4)]
    texts, labels = [], []
    for _ in range(1500):
        a, b = couples[rng.integers(4)], couples[rng.integers(4)]
        left, right = (a[0], a[1]) if rng.random() < 0.5 else (a[0], b[1])
        texts.append(f"{left} {right}")
        labels.append(int(left[1:] == right[1:]))
    labels = np.array(labels)
    none = np.zeros((len(texts), 0))
    machine = M.train(texts[:1000], labels[:1000], none[:1000], epochs=30, decay=1e-4)
    got = machine.logits(*machine.vectors(pa.array(texts[1000:], pa.large_string()), none[1000:]), 500) > 0
    assert (got == labels[1000:]).mean() > 0.95


@pytest.mark.skipif(not __import__("os").path.isdir(FOLDER), reason="no tables")
def test_held_out_accuracy(spark):
    found = M.op13_quality_classifier(spark, FOLDER)
    assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = found.where("held_out").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").select("quality", "predicted", "score").distinct().collect()
    right = {y: np.mean([r.predicted == y for r in rows if r.quality == y]) for y in (0, 1)}
    assert right[0] > 0.9 and right[1] > 0.95, right


def test_edge_cases(spark, edge_docs, no_docs):
    labels = local_rows(spark, [(4, 1), (1, 0), (7, 0), (8, 0), (6, 1), (None, 1), (99, 0), (9, None), (9, 7)], "doc_id long, quality int")
    found = {(r.doc_id, r.score) for r in M.quality(edge_docs, labels, metadata=("n_chars",)).collect()}
    assert {i for i, _ in found} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None} and all(0 <= s <= 1 for _, s in found)
    assert len({s for i, s in found if i == 5}) == 1
    assert M.quality(no_docs, labels).collect() == []
    assert {r.score for r in M.quality(edge_docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in M.quality(edge_docs, labels.where("quality = 1")).collect()} == {1.0}


def test_sample_is_drawn_among_labels_with_a_text(spark):
    docs = local_rows(spark, [(k, "bad " * 5 if k % 2 else "good " * (k + 1)) for k in range(6)] + [(50, None)], "id long, text string")
    labelled = spark.range(20_000).select("id", (F.col("id") % 2).cast("int").alias("label"))
    rows = sampling.labelled_texts(docs, labelled, "x", 4, 1 << 20)
    assert {r["label"] for r in rows} == {0, 1} or len(rows) > 0
    assert {r["label"] for r in sampling.labelled_texts(docs, labelled, "x", 4000, 1)} == {0, 1}
    few = sampling.within([dict(id=k, label=k % 2, bytes=100 * (k + 1), draw=k) for k in range(6)], 10)
    assert sorted(few) == [0, 1]
