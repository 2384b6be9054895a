import collections
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamiz.llm import jaccard as J
from tamiz.llm.components import components


def brute(rows):
    """Classes by an inverted index over all shingles."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, common = collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for t in s:
            holders[t].append(i)
    for found in holders.values():
        common.update((a, b) for n, a in enumerate(found) for b in found[:n])
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed):
    """Near copies in chains and stars, a passage that many share, exact copies, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    rows = [None, "", "one", "One", "one two", "two one", "a b c d", "A B c d", "a b c d e", " a b\tc d\ne "]
    for _ in range(12):
        text = [word() for _ in range(rng.choice([6, 12, 30, 90]))]
        for _ in range(rng.randint(1, 12)):
            rows.append(" ".join(text))
            if rng.random() < 0.7:
                text = list(text)
                for _ in range(rng.randint(1, 2)):
                    text[rng.randrange(len(text))] = word()
            if rng.random() < 0.2:
                text = text + [word()]
    rows += [" ".join([word() for _ in range(rng.randint(0, 40))] + passage + [word() for _ in range(rng.randint(0, 40))]) for _ in range(60)]
    base = [word() for _ in range(50)]
    for _ in range(50):  # one large set of near copies
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(50)] = word()
        rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,common", [(1, 16), (2, 3), (3, 10_000)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, common):
    monkeypatch.setattr(J, "COMMON", common)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_classes(docs).collect()}
    assert got == brute(rows)


def test_small_limits_change_nothing(spark, monkeypatch):
    for name, value in (("FLUSH", 50), ("RANGE_ENTRIES", 40), ("BLOCK_NODES", 2), ("MEMBERS", 2), ("MOST_BROADCAST", 0), ("MOST_COMMON", 5)):
        monkeypatch.setattr(J, name, value)
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_classes(docs).collect()} == brute(rows)


def test_pages_of_one_template_meet_as_blocks(spark, monkeypatch):
    """A template fills most of every page, so all share shingles, and only the planted pairs link; pages are asked by block."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template = [word() for _ in range(60)]
    rows = []
    for k in range(400):
        own = [word() for _ in range(24)]
        rows.append(template + own)
        if k % 8 == 0:
            rows.append(template + own[:-3] + [word() for _ in range(3)])
    rng.shuffle(rows)
    rows = [(k, " ".join(r)) for k, r in enumerate(rows)]
    asked, plain = [], J.block_links
    monkeypatch.setattr(J, "block_links", lambda a, blocks, sets: asked.append((a.count(), blocks.groupBy("block").count().count())) or plain(a, blocks, sets))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_classes(docs).collect()}
    assert got == brute(rows)
    assert sum(k != c for k, (_, c) in got.items()) == 50
    (queries, blocks), = asked
    assert blocks <= 64 and queries <= len(rows) * blocks


def test_batches_are_lowered_only(spark):
    from tamiz.llm.store import bounded_batches
    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(n) for n in names]
    try:
        for given, expected in (("0", "64m"), ["1000", 4 << 20]), (("50", "1k"), ["50", 1 << 10]):
            for name, value in zip(names, given):
                spark.conf.set(name, value)
            bounded_batches(spark)
            found = [spark.conf.get(n) for n in names]
            assert found[0] == expected[0] and found[1] in (str(expected[1]), f"{expected[1]}b", "1k")
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def test_shingle_sets_keep_texts_apart():
    grams, bounds = J.shingle_sets(pa.array(["a b c d e f", None, "", "A B C D E F", "e f", "f"]))
    sets = [grams[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert [len(s) for s in sets] == [2, 0, 0, 2, 1, 1] and sets[0] == sets[3] and sets[4] != sets[5]


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got = J.jaccard_classes(edge_docs).collect()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert len(got) == len(edge_rows) + 0 and found[1] == (0, 1) and found[2] == (0, 2) and found[5][1] == 4 and found[None] == (0, None)
    assert J.jaccard_classes(no_docs).count() == 0
    left = J.one_of_each_class(edge_docs)
    assert left.columns == edge_docs.columns and sorted(r["doc_id"] or 0 for r in left.select("doc_id").collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200)] + [(300 + (k * 7) % 20, 300 + ((k + 1) * 7) % 20) for k in range(20)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys(range(300, 320), 300)}


def test_empty_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_common_prints_pass_over_empty_classes(spark):
    """A group of 10,000 copies leaves classes empty below it; the next ones are common all the same."""
    seen = spark.createDataFrame([(1, 10_000), (2, 10_001), (3, 100), (4, 9), (5, 8), (6, None)], "print long, df long")
    for most, want in ((10, {1: 13, 2: 13, 3: 6, 4: 3, 5: 3}), (4, {1: 13, 2: 13, 3: 6}), (2, {1: 13, 2: 13}), (1, {})):
        prints, classes = J.common_prints(seen, most)
        assert dict(zip(prints.tolist(), classes.tolist())) == want
