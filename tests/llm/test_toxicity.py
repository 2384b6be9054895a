import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamiz.llm import toxicity as X
from tamiz.llm.sampling import labelled_texts

INSULTS = {"xx": ["grumpf", "blarg"], "yy": ["stinkei", "stinkeit", "stinkung"]}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(700):
        lang = rng.choice(["xx", "yy"])
        words = ["".join(rng.choice("kato mire nshi" if lang == "xx" else "schung einkeit").strip() for _ in range(rng.randint(2, 6))) for _ in range(rng.choice([5, 40, 150]))]
        toxic = int(rng.random() < 0.3)
        for _ in range(2 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(INSULTS[lang]))
        docs.append((k, " ".join(words), lang))
        if k % 7:
            labels.append((k, 1, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(corpus):
    docs, labels = corpus
    got = X.toxicity(docs, labels, F.col("doc_id") % 5 != 0).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    hits = [(r["score"] >= 0.5) == (r["toxic"] == 1) for r in got]
    assert len(hits) > 100 and np.mean(hits) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_labels_and_language_are_no_inputs_of_a_score(corpus):
    docs, labels = corpus
    other = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.lit("qq")).otherwise(F.col("lang")))
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r["doc_id"]: round(r["score"], 9) for r in X.toxicity(d, y, F.col("doc_id") % 5 != 0).collect()} for d, y in ((docs, labels), (other, flipped)))
    assert one == two


def test_pooling_equals_brute_force():
    rng = np.random.default_rng(1)
    net = X.Net(rng.normal(size=(X.BUCKETS, X.DIM)).astype(np.float32), [rng.normal(size=(w, X.DIM, X.FILTERS)).astype(np.float32) for w in X.WIDTHS],
                [rng.normal(size=X.FILTERS).astype(np.float32) for _ in X.WIDTHS], np.ones(X.FILTERS * 3, np.float32), 0.5)
    texts = ["one two three", "", None, "One, two!", "x"]
    buckets, text_of = X.buckets_of(pa.array(texts))
    assert np.bincount(text_of, minlength=5).tolist() == [3, 0, 0, 2, 1] and (buckets[0] == buckets[3]).all()
    pooled = X.pool(net, buckets, text_of, 5)[0]
    for t in range(5):
        words = [net.embedding[b].sum(axis=0) for b in buckets[text_of == t]] + [np.zeros(X.DIM, np.float32)] * X.PAD
        for k, w in enumerate(X.WIDTHS):
            padded = words + [np.zeros(X.DIM, np.float32)] * w
            best = np.max([np.maximum(sum(padded[i + j] @ net.kernels[k][j] for j in range(w)) + net.biases[k], 0) for i in range(len(words))], axis=0)
            assert np.allclose(pooled[t, k * X.FILTERS:(k + 1) * X.FILTERS], best, atol=1e-4)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in X.toxicity(edge_docs, none).collect()} == {0.0}
    nulls = spark.createDataFrame([(None, 1, 1), (4, None, None), (7, None, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in X.toxicity(edge_docs, nulls).collect()} == {1.0}
    both = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (7, 1, 1), (8, 1, 1), (8, 1, 1)], "doc_id long, quality int, toxic int")
    got = X.toxicity(edge_docs, both).collect()
    assert len(got) == len(edge_rows) and len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert X.toxicity(no_docs, both).count() == 0


def test_a_long_text_does_not_end_the_sample(spark):
    """A text over the byte bound stays out, all others are in the sample, of both labels."""
    docs = spark.createDataFrame([(k, "x " * 50_000 if k == 7 else f"text {k} ", "en") for k in range(40)], "id long, text string, lang string")
    labelled = spark.createDataFrame([(k, k % 2) for k in range(40)], "id long, label int")
    got = labelled_texts(docs, labelled, "toxicity", 4000, 50_000)
    assert len(got) == 39 and sum(r["label"] for r in got) == 19 and all(len(r["text"]) < 100 for r in got)
    assert len(labelled_texts(docs, labelled, "toxicity", 4000, 101_000)) == 40


def test_good_data_never_ends_with_an_error(spark):
    """Labels of documents that are not there take no place in the sample, and a label of long texts only keeps its shortest."""
    docs = spark.createDataFrame([(k, ("bad word " if k % 2 else "fine thing ") * (20_000 if k % 2 else 3), "en") for k in range(6)], "doc_id long, text string, lang string")
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    found = {r["doc_id"]: r["score"] for r in X.toxicity(docs, labels, sample_rows=4, sample_bytes=1000).collect()}
    assert len(found) == 6 and all(0 <= s <= 1 for s in found.values())
