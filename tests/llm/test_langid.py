import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamiz.llm import langid as L

SYLLABLES = {"xx": "ka to mi ren shi no wa".split(), "yy": "schö ung ein keit der ver".split(), "zz": "ção nha lho est ar pre".split()}


def text_in(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = [(k, text_in(lang, rng, rng.choice([3, 20, 200])), lang) for k, lang in enumerate(rng.choice(["xx", "xx", "yy", "zz"]) for _ in range(600))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_held_out_accuracy_and_nothing_clean_rejected(corpus):
    got = L.identify(corpus, F.col("doc_id") % 4 != 2).join(corpus.select("doc_id", "lang"), "doc_id").where("doc_id % 4 = 2").collect()
    assert len(got) == 150 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert sum(r["rejected"] for r in got) == 0 and all(0 <= r["score"] <= 1 for r in got)


def test_the_label_is_no_input_of_a_prediction(corpus):
    hidden = corpus.withColumn("lang", F.when(F.col("doc_id") % 4 == 2, F.lit("yy")).otherwise(F.col("lang")))
    one, two = ({r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in L.identify(x, F.col("doc_id") % 4 != 2).collect()} for x in (corpus, hidden))
    assert one == two


def test_far_texts_are_rejected(spark, corpus):
    odd = spark.createDataFrame([(9001, "шшш жжж ццц " * 40, None), (9002, "漢字" * 80, None), (9003, None, "xx"), (9004, "12 34", "xx")], "doc_id long, text string, lang string")
    docs = corpus.union(odd)
    got = {r["doc_id"]: r for r in L.identify(docs).where("doc_id > 9000").collect()}
    assert all(r["rejected"] for r in got.values()) and got[9003]["lang_pred"] == got[9004]["lang_pred"] == "und" and got[9001]["lang_pred"] in SYLLABLES
    kept = L.identified(docs)
    assert kept.columns == docs.columns and kept.count() == 600


def test_counts_equal_brute_force():
    texts = ["Aß b", None, "", "x", "ab-ab 9"]
    got = L.counts(pa.array(texts))
    for row, text in zip(got, texts):
        raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in (text or "").lower().encode())
        want = np.zeros(L.BUCKETS)
        for size in (2, 3):
            for k in range(len(raw) - size + 1):
                key = 0
                for b in raw[k:k + size]:
                    key = (key * 0x01000193 + b + 1) % 2 ** 32
                want[(key * 0x9E3779B1) % 2 ** 32 >> (32 - L.BITS)] += 1
        assert (row == want).all()


def test_edges(edge_docs, edge_rows, no_docs):
    got = L.identify(edge_docs).collect()
    assert len(got) == len(edge_rows)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in next(t for i, t, *_ in edge_rows if i == r["doc_id"]) or "")) for r in got)
    assert L.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in L.identify(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.identified(edge_docs).columns == edge_docs.columns and L.identified(no_docs).count() == 0


def test_packed_vectors_come_back():
    rows = L.counts(pa.array(["some words here", "", "x" * 100]))
    assert (L.unpacked([L.packed(r) for r in rows]) == rows).all()


def test_rates_of_rejection_on_documents(spark):
    """Few clean rows go; texts of random letters and of a language that was not learned do."""
    from pathlib import Path
    folder = "/root/testdata/sf0.1"
    if not Path(folder).exists():
        pytest.skip("no tables")
    rng = random.Random(2)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 3000")
    base = [r["text"] or "" for r in docs.where("lang <> 'de'").orderBy("doc_id").limit(150).collect()]
    noise = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in t.split()) for t in base for letters in ("bcdfghjklmnpqrstvwxz", "abcdefghijklmnopqrstuvwxyz")]
    odd = spark.createDataFrame([(10 ** 6 + k, t, None) for k, t in enumerate(noise)], "doc_id long, text string, lang string").where("length(text) > 200")
    learned = docs.where("lang <> 'de'")
    kept = L.identified(learned.union(odd).union(docs.where("lang = 'de'").withColumn("lang", F.lit(None).cast("string")))).join(
        docs.select("doc_id", F.col("lang").alias("is")), "doc_id", "left").groupBy("is").count().collect()
    kept = {r["is"]: r["count"] for r in kept}
    assert kept.get(None, 0) <= 0.1 * odd.count()
    assert kept.get("de", 0) <= 0.25 * docs.where("lang = 'de'").count()
    assert sum(kept[x] for x in ("en", "fr", "es")) >= 0.995 * learned.where("text RLIKE '\\\\p{L}'").count()
