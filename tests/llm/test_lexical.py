"""Ranked lexical search against plain scoring of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tamiz.llm import lexical as X
from tamiz.session import local_rows

TERM = re.compile(X.TERM)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(docs, items, k):
    found = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in found]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for i, t in dict.fromkeys(items):
        if t is not None:
            asked.setdefault(i, Counter()).update(TERM.findall(lower(t)))
    out = []
    for i, terms in asked.items():
        scored = []
        for (d, c), size in zip(found, sizes):
            if size:
                m = 75 + (25 * size * n) // total
                s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in terms.items() if c[t])
                if s > 0:
                    scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünï", "İstanbul", "x" * 300]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    return [(int(d), " ".join(rng.choice(vocabulary, rng.integers(0, 40), p=weights / weights.sum()))) for d in rng.integers(0, n * 2, n)]


def test_against_brute_force(spark, monkeypatch):
    docs = corpus(400) + [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (5, None), (6, ""), (7, " .,;"), (8, "W1-w1_W1 " * 4000)]
    items = [(1, "w1 w2 w59"), (2, "W3 w3 w3, Ünï"), (3, None), (4, ""), (5, "nothing here"), (None, "w1"), (6, "w0"), (6, "w0"), (6, "w9"), (7, "İstanbul " + "x" * 300), (8, "w40 w41 w42 w43 w1 w1")]
    frame = local_rows(spark, [(d, t, "a", 1, 2) for d, t in docs], "doc_id long, text string, item string, score int, rank int").repartition(3)
    asked = local_rows(spark, [(i, t, 9) for i, t in items], "item_id long, text string, id int")
    want = sorted(brute(docs, items, 20), key=str)
    assert rows_of(X.search(frame, asked)) == want
    monkeypatch.setattr(X, "STEP", 1)
    assert rows_of(X.search(frame, asked, block_terms=5)) == want


@pytest.mark.parametrize("step", [1, 3, 32])
def test_best_positions_stop_early_and_lose_nothing(step):
    rng = np.random.default_rng(step)
    for trial in range(30):
        n_docs, n_terms = 500, 6
        cells = np.flatnonzero(rng.random(n_docs * n_terms) < 0.3)
        impacts = rng.integers(1, 12 if trial % 2 else 5000, len(cells))
        lists = X.Lists(cells % n_docs, cells // n_docs, impacts, n_docs)
        factors = rng.integers(1, 3, n_terms)
        full = np.zeros(n_docs, np.int64)
        np.add.at(full, cells % n_docs, impacts * factors[cells // n_docs])
        docs, scores, depth = X.best_positions(lists, np.arange(n_terms), factors, 5, 0, step)
        assert (full[docs] == scores).all() and len(set(docs.tolist())) == len(docs)
        best = sorted(zip(-full, range(n_docs)))[:5]
        assert sorted(zip(-scores, docs))[:5] == best


def test_threshold_of_best_positions_is_tighter_than_of_the_reading():
    # The first documents of list 0 are those of list 1 in turn, so reading one position marks the tops of both lists.
    lists = X.Lists(np.array([0, 1, 2, 3, 1, 0, 3, 2]), np.repeat([0, 1], 4), np.array([90, 80, 9, 8, 90, 80, 9, 8]), 4)
    docs, scores, depth = X.best_positions(lists, np.array([0, 1]), np.array([1, 1]), 2, 0, 1)
    assert depth == 1 and sorted(docs.tolist()) == [0, 1] and scores.tolist() == [170, 170]


def test_words_of_equal_keys_are_told_apart(monkeypatch):
    from tamiz.llm import words as W
    monkeypatch.setattr(W, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    vocabulary = X.Vocabulary(["abc", "abd", "xy"])
    data = np.frombuffer(b"abd abx xy abc", np.uint8)
    assert vocabulary.find(data, np.array([0, 4, 8, 11]), np.array([3, 7, 10, 14])).tolist() == [1, -1, 2, 0]


def test_empty_tables(spark):
    docs, none = local_rows(spark, [(1, "a b")], "doc_id long, text string"), local_rows(spark, [], "doc_id long, text string")
    items, no_items = local_rows(spark, [("x", "a")], "item_id string, text string"), local_rows(spark, [], "item_id string, text string")
    assert X.search(none, items).collect() == [] and X.search(docs, no_items).collect() == []
    assert X.search(docs, items).dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
