"""Cross-tokenizer alignment against a plain merge of both sides' ends."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tamiz.llm import crosstoken as C
from tamiz.session import local_rows

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=0, max_size=300), st.sets(st.integers(0, 700)), st.integers(1, 40))
def test_runs_and_irregular_groups(steps, extra, lane):
    ends = np.cumsum(steps)
    last = ends[-1] if len(ends) else 0
    other = np.array(sorted({int(x) for x in ends if x % 7} | {x for x in extra if 0 < x < last} | ({int(last)} if last else set())), np.int64)
    a, b = C.align(ends.astype(np.int64), other, lane)
    common = sorted(set(ends.tolist()) & set(other.tolist()))
    assert ends[a].tolist() == common and other[b].tolist() == common


def test_one_long_stretch_and_no_common_end():
    long = np.arange(1, 200_001)
    assert len(C.align(long, long)[0]) == 200_000
    a, b = C.align(np.array([2, 4, 6, 9]), np.array([1, 3, 5, 9]), 1)
    assert a.tolist() == [3] and b.tolist() == [3]


def tokens(text, tokenizer, model):
    """Both sides' ``(id, bytes)``, each side encoded as one whole text."""
    chars = C.byte_tokens(A)
    a = [(k, chars[k]) for k in tokenizer.encode(" " + text, add_special_tokens=False).ids]
    b = [(k, bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode()) for k in model.encode(text)]
    return a, b


def brute(rows):
    tokenizer, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    found, counts = [], Counter()
    for doc, text in rows:
        a, b = tokens(text, tokenizer, model) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            found.append((doc, [], [], []))
            continue
        groups, i, j, at, bt = [], 0, 0, 0, 0
        ga, gb = [], []
        while i < len(a) or j < len(b):
            if at <= bt and i < len(a):
                ga.append(a[i][0]); at += len(a[i][1]); i += 1
            else:
                gb.append(b[j][0]); bt += len(b[j][1]); j += 1
            if at == bt and ga and gb:
                groups.append((ga, gb)); ga, gb = [], []
        counts.update((x[-1], y[-1]) for x, y in groups)
        found.append((doc, a, b, groups))
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = []
    for doc, a, b, groups in found:
        linked = [counts[x[-1], y[-1]] for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, len(a), len(b), len(groups), len(groups), sum(n == highest[y[-1]] for n, (_, y) in zip(linked, groups)), sum(linked),
                    sha256(text.encode()).hexdigest() if groups else ""))
    return out


TEXTS = [None, "", " ", "a", "a  b", "  lead and trail \n", "the the the the", "The quick brown fox.\nNext line\t\ttabbed", "naïve café — Ünïcödé ß", "日本語のテキスト", "🙂🙃 emoji",
         "U+2581 ▁ literal", "<|endoftext|> <s> </s> <0x41> <unk>", "x\x00y", "　wide", "don't won't I'll", "12345 678 90", "the the the the", "word " * 50, "ﬁ ligature"]


def test_documents_against_brute_force(spark):
    rows = [(k % 17 if k != 3 else None, t) for k, t in enumerate(TEXTS * 2)]
    docs = local_rows(spark, [(d, t, "x", 1) for d, t in rows], "doc_id long, text string, chunk string, n_a int").repartition(3)
    got = C.aligned(docs, A, B).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_long_texts_are_cut_where_neither_side_merges(monkeypatch):
    both = C.Both(A, B)
    text = " ".join(f"word{k} naïve  two\nlines x" + "y" * (k % 9) for k in range(900))
    whole = both.encode(text)
    monkeypatch.setattr(C, "STRETCH", 64)
    assert len(both.stretches(text)) > 200
    cut = both.encode(text)
    assert all(np.array_equal(x, y) for x, y in zip(whole, cut)) and len(cut[0]) > 1000


def test_real_documents(spark):
    import os
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = C.op11_cross_tokenizer(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_empty_table(spark):
    docs = local_rows(spark, [], "doc_id string, text string")
    found = C.aligned(docs, A, B)
    assert found.collect() == [] and found.schema["doc_id"].dataType.simpleString() == "string"
