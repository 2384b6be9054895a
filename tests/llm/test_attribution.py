import random

import numpy as np
import pytest

from tamiz.llm import attribution as A
from tamiz.llm.tokens import Stretches


def brute(text, offsets, rule):
    parts = text.split("\n")
    lines = [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])
    bounds, at = [], 0
    for line in lines:
        bounds.append((at, at + len(line)))
        at += len(line)
    counts, crossing = [0] * len(bounds), [0] * len(bounds)
    for a, b in offsets:
        held = [max(0, min(b, y) - max(a, x)) for x, y in bounds]
        k = held.index(max(held)) if rule == "majority" else next(n for n, h in enumerate(held) if h)
        counts[k] += 1
        crossing[k] += sum(h > 0 for h in held) > 1
    return [(n, *bounds[n], counts[n], crossing[n]) for n in range(len(bounds))]


@pytest.mark.parametrize("rule", ["majority", "start"])
def test_lines_equal_brute_force(tokenizer_path, rule):
    rng = random.Random(5)
    texts = ["", "\n", "\n\n", "a\n"] + ["".join(rng.choice(["a ", "b", "\n", "\n\n\n", "é", " \n", "😀", "\t"]) for _ in range(rng.randint(0, 14))) for _ in range(700)]
    encoder = Stretches(tokenizer_path, True)
    got = A._rows(texts, [A.line_sections(t) for t in texts], encoder, rule)
    for n, text in enumerate(texts):
        offsets = encoder.tokenizer.encode(text, add_special_tokens=False).offsets
        assert [tuple(map(int, r[1:])) for r in got[got[:, 0] == n]] == brute(text, offsets, rule), text


def test_gaps_and_ties():
    sections = np.array([[0, 2], [2, 2], [4, 6]])
    spans = np.array([[0, 1], [1, 3], [2, 4], [3, 5], [1, 5], [0, 6], [6, 7]])
    assert A.attribute(spans, sections)[0].tolist() == [0, 0, -1, 2, 0, 0, -1]
    assert A.attribute(spans, sections, "start")[0].tolist() == [0, 0, -1, 2, 0, 0, -1]
    assert A.attribute(np.array([[1, 6]]), sections)[0].tolist() == [2] and A.attribute(np.array([[1, 6]]), sections, "start")[0].tolist() == [0]
    assert A.attribute(spans, np.zeros((0, 2), int))[0].tolist() == [-1] * 7
    with pytest.raises(ValueError):
        A.attribute(spans, sections, "other")


def test_edges(spark, edge_docs, edge_rows, tokenizer_path, no_docs):
    got = A.count_sections(edge_docs, tokenizer_path).collect()
    tokenizer = Stretches(tokenizer_path).tokenizer
    for i in {r["doc_id"] for r in got}:
        texts = [t or "" for k, t, *_ in edge_rows if k == i]
        assert sum(r["n_tokens"] for r in got if r["doc_id"] == i) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts)
    assert {r["doc_id"] for r in got} == {i for i, *_ in edge_rows} and A.count_sections(no_docs, tokenizer_path).count() == 0


def test_fields_add_up_to_the_whole(spark, tokenizer_path):
    rows = spark.createDataFrame([(1, "A title", "Body text. More", 3), (2, None, "", None)], "doc_id long, title string, body string, n int")
    got = {(r["doc_id"], r["field"]): r["n_tokens"] for r in A.count_fields(rows, ["title", "body", "n"], tokenizer_path).collect()}
    encoder = Stretches(tokenizer_path).tokenizer
    assert sum(v for (i, _), v in got.items() if i == 1) == len(encoder.encode("A title\nBody text. More\n3", add_special_tokens=False).ids)
    assert got[1, "title"] == 2 and got[1, "n"] == 1 and got[1, None] == 2 and got[2, "title"] == 0
