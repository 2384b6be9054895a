
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tamiz.llm import pii
from tamiz.llm.store import stored

from test_jaccard import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in C.STAGES:
        out[name] = docs = stored(stage(spark, docs, SF), name)
    return out


def test_stages_take_effect(spark, steps):
    columns = steps["documents"].columns
    assert all(steps[n].columns == columns for n, _ in C.STAGES[:-1])
    clean = {r["doc_id"]: r for r in steps["documents"].collect()}
    after = {r["doc_id"] for r in steps["language_id"].select("doc_id").collect()}
    assert after <= set(clean) and all(any(c.isalpha() for c in clean[i]["text"] or "") for i in after) and len(after) >= 0.98 * len(clean)
    classes = brute([(i, clean[i]["text"]) for i in sorted(after)])
    assert {r["doc_id"] for r in steps["jaccard_join"].collect()} == {i for i, (_, c) in classes.items() if c == i}
    for r in steps["personal_data"].collect():
        text = clean[r["doc_id"]]["text"]
        assert r["text"] == pii.redact(text, pii.find_spans(text)) and r["n_chars"] == len(r["text"])
    kept = {r["doc_id"]: r["text"] for r in steps["personal_data"].collect()}
    times = {}
    for r in steps["source_mix"].collect():
        assert r["text"] == kept[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) == 2
    packed = {r["doc_id"]: r["n"] for r in steps["best_fit_packing"].where("piece = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert packed == times


def test_run_equals_the_stages(spark, steps):
    per = ["doc_id", "piece", "start", "length", "ids_crc32"]
    one, two = (sorted(map(tuple, df.select(*per).collect())) for df in (C.run(spark, SF), steps["best_fit_packing"]))
    assert one == two


def test_empty_and_odd_documents(spark, edge_docs, tmp_path):
    for name, df in (("odd", edge_docs.select("doc_id", "text", "lang", "source", "n_chars")), ("none", edge_docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars"))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = C.run(spark, f"{tmp_path}/{name}")
        assert got.count() >= 0 and (name == "odd" or got.count() == 0)
