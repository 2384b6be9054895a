"""Cross-tokenizer alignment: where two tokenizers' tokens of one text end together.

Every text is encoded twice, by a byte-level BPE (A, over space + text) and a sentencepiece model (B, which adds the space itself). A
token's end is a byte offset; offsets where tokens of both sides end cut the text into groups. The ends are two ascending arrays,
and the alignment is a walk along both by diagonal run skipping:

* Within a one-to-one stretch both arrays agree at a constant index shift ``j - i``. A lane compares a window of the arrays at its
  shift, and the window doubles as long as all of it agrees (exponential probing), so a stretch of ``n`` tokens is jumped in
  ``log n`` steps; the first difference ends the stretch.
* At a difference the group is irregular: the side that is behind moves on until both ends meet. The group ends there, the shift
  is updated, and probing starts anew with a window of one.

The arrays of a slice of texts are laid end to end (both sides have the same bytes, so every text's end is common). Lanes start at
common ends found by binary search from every ``LANE``-th token of A and run side by side in numpy; a lane that finds no common
end at its start is part of the one before.

A text that is null or empty, or whose tokens do not give back the bytes of space + text on either side, has no tokens: its counts
are 0 and its digest is ''. Special tokens' strings are plain text. Links are the pairs of tokens that end together, one for each
group. Counts of id pairs are of the whole corpus: each slice of texts is one chunk that keeps its distinct pairs, so an id pair is
shuffled once a chunk, however often it occurs; chunk and counts meet again by chunk number. Repeated rows count one by one, null
ids are kept, only the two named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm import words as W
from tamiz.llm.store import stored
from tamiz.llm.tokens import same_ranks

#: Text of one chunk, tokens of one lane, characters encoded at once.
CHUNK_BYTES, LANE, STRETCH = 2 << 20, 64, 1 << 15
_FAR = np.iinfo(np.int64).max
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def align(a: np.ndarray, b: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of both sides that end at common offsets; ``a`` and ``b`` ascend strictly to the same last end."""
    n = len(a)
    end_a, end_b = np.zeros(n, bool), np.zeros(len(b), bool)
    if n and len(b):
        starts = np.arange(lane, n, lane)
        place = np.searchsorted(b, a[starts - 1])
        common = b[np.minimum(place, len(b) - 1)] == a[starts - 1]
        i, j = np.append(0, starts[common]), np.append(0, place[common] + 1)
        stop_i, stop_j, window = np.append(i[1:], n), np.append(j[1:], len(b)), np.ones(len(i), np.int64)
    else:
        i = j = stop_i = stop_j = window = np.zeros(0, np.int64)
    while len(i):
        # Probe: compare both arrays at each lane's shift, as far as its window reaches.
        size = np.minimum(window, np.minimum(stop_i - i, stop_j - j))
        first = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(first, size)
        at, shifted = np.repeat(i, size) + step, np.repeat(j, size) + step
        run = np.minimum(np.minimum.reduceat(np.where(a[at] == b[shifted], _FAR, step), first), size)
        in_run = step < np.repeat(run, size)
        end_a[at[in_run]] = True
        end_b[shifted[in_run]] = True
        i, j, whole = i + run, j + run, run == size
        window = np.where(whole, 2 * window, 1)
        # Irregular groups: the side behind moves until the ends meet.
        odd = np.flatnonzero(~whole)
        x, y = i[odd], j[odd]
        apart = np.arange(len(odd))
        while len(apart):
            p, q = a[x[apart]], b[y[apart]]
            x[apart] += p < q
            y[apart] += q < p
            apart = apart[p != q]
        end_a[x] = True
        end_b[y] = True
        i[odd], j[odd] = x + 1, y + 1
        going = i < stop_i
        i, j, stop_i, stop_j, window = i[going], j[going], stop_i[going], stop_j[going], window[going]
    return np.flatnonzero(end_a), np.flatnonzero(end_b)


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE file; ids without a token, and special ones, stand for no bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = dict(zip(map(chr, printable), printable)) | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(printable)))}
    special = {t["id"] for t in spec.get("added_tokens", [])}
    out = [b""] * (1 + max([*spec["model"]["vocab"].values(), *special]))
    for token, k in spec["model"]["vocab"].items():
        if k not in special:
            out[k] = bytes(chars[c] for c in token)
    return out


def _digits(n: int) -> np.ndarray:
    """Decimal digits of the numbers below ``n``, left-aligned in rows that end in zeros, with room for a sign behind each."""
    width = len(str(max(0, n - 1)))
    return np.array([str(k).encode() for k in range(n)], f"S{width + 1}").view(np.uint8).reshape(n, width + 1)


class Both:
    """Both tokenizers, loaded once in a worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.ranks, _ = same_ranks(a_path)
        self.plain = Tokenizer.from_file(a_path)
        self.plain.encode_special_tokens = True
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        #: No piece holds a space behind another character, so nothing is merged across a lone space.
        self.parted = not any("▁" in p.lstrip("▁") for p in pieces) and self.ranks is not None
        self.a_bytes = byte_tokens(a_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        width = max(len(self.a_bytes), len(self.b_bytes))
        self.digits = _digits(width)

    def stretches(self, text: str) -> list[str]:
        """Long texts are encoded by stretches that end before a lone space, across which neither side merges."""
        if len(text) <= STRETCH or not self.parted:
            return [text]
        out, at = [], 0
        while cut := _LONE_SPACE.search(text, at + STRETCH):
            out.append(text[at:cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none where a side's bytes are not those of space + text."""
        none = np.zeros(0, np.int32), np.zeros(0, np.int32)
        if not text:
            return none
        found: tuple[list, list] = [], []
        for part in self.stretches(text):
            spaced = " " + part
            a = self.ranks.encode_ordinary(spaced) if self.ranks else self.plain.encode(spaced, add_special_tokens=False).ids
            b = self.model.encode(part, num_threads=1)
            raw = spaced.encode()
            if b"".join([self.a_bytes[k] for k in a]) != raw or b"".join([self.b_bytes[k] for k in b]) != raw:
                return none
            found[0].append(np.array(a, np.int32))
            found[1].append(np.array(b, np.int32))
        return np.concatenate(found[0]), np.concatenate(found[1])

    def written(self, a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;`` for every group, as bytes, and the byte at which each group ends."""
        a_sizes, b_sizes = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        rows = np.empty((len(a_ids) + len(b_ids), self.digits.shape[1] + 1), np.uint8)
        a_at = np.arange(len(a_ids)) + np.repeat(np.cumsum(b_sizes) - b_sizes, a_sizes)
        b_at = np.arange(len(b_ids)) + np.repeat(np.cumsum(a_sizes), b_sizes)
        rows[a_at, :-1] = self.digits[a_ids]
        rows[b_at, :-1] = self.digits[b_ids]
        rows[:, -1] = ord(",")
        rows[a_at[a_last], -1] = ord("|")
        rows[b_at[b_last], -1] = ord(";")
        used = rows != 0
        ends = np.cumsum(used.sum(axis=1))
        return rows[used], ends[b_at[b_last]]


@lru_cache(maxsize=2)
def both(a_path: str, b_path: str) -> Both:
    """One for each Python worker."""
    return Both(a_path, b_path)


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each slice of texts: figures of its documents as lists, its distinct id pairs and how often it links them
    (``pairs``, ``counts``; a pair is the A id times 2**32 plus the B id), and for each document the pairs that it links
    (``places`` in ``pairs``, ``times``; ``cells`` of them)."""
    kind = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        mine = TaskContext.get().partitionId() << 32
        for number, piece in enumerate(W.slices(batches, "text", CHUNK_BYTES)):
            tokenizers = both(a_path, b_path)
            encoded = [tokenizers.encode(t or "") for t in piece.column(1).to_pylist()]
            n_a, n_b = (np.array([len(e[k]) for e in encoded], np.int64) for k in (0, 1))
            a_ids, b_ids = (np.concatenate([e[k] for e in encoded]) for k in (0, 1))
            del encoded
            a_last, b_last = align(np.cumsum(tokenizers.a_size[a_ids]), np.cumsum(tokenizers.b_size[b_ids]))
            groups = np.searchsorted(a_last, _bounds(n_a))
            n_groups = np.diff(groups)
            text, ends = tokenizers.written(a_ids, b_ids, a_last, b_last)
            edge = np.concatenate([[0], ends])[groups]
            shas = [hashlib.sha256(text[edge[k]:edge[k + 1] - 1]).hexdigest() if n_groups[k] else "" for k in range(len(n_groups))]
            pairs, place, counts = np.unique(a_ids[a_last].astype(np.int64) << 32 | b_ids[b_last], return_inverse=True, return_counts=True)
            cell, times = np.unique(np.repeat(np.arange(len(n_groups)), n_groups) * max(1, len(pairs)) + place, return_counts=True)
            cells = np.bincount(cell // max(1, len(pairs)), minlength=len(n_groups))
            values = [[mine | number], [piece.column(0).to_pylist()], [n_a], [n_b], [n_groups], [shas], [cells.astype(np.int32)],
                      [(cell % max(1, len(pairs))).astype("<u4").tobytes()], [times.astype("<u4").tobytes()], [pairs], [counts]]
            listed = [pa.int64(), pa.list_(piece.schema.field(0).type), *[pa.list_(pa.int64())] * 3, pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(),
                      pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["chunk", "ids", "n_a", "n_b", "n_groups", "shas", "cells", "places", "times", "pairs", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, listed)], names=names)

    return docs.select("id", "text").mapInArrow(work, f"chunk long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, shas array<string>, "
                                                "cells array<int>, places binary, times binary, pairs array<long>, counts array<long>")


def pair_counts(cut: DataFrame) -> DataFrame:
    """``(pair, total, best)``: links of each id pair in the corpus, and whether no pair with its B id has more."""
    found = cut.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = stored(found.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pairs")
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    return totals.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every document."""
    src = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    cut = stored(chunks(src, a_path, b_path), "alignment")
    places = cut.select(F.col("chunk").alias("of_chunk"), F.posexplode("pairs").alias("place", "pair"))
    known = places.join(pair_counts(cut), "pair").select("of_chunk", "place", "total", "best")
    kind = src.schema["id"].dataType.simpleString()

    def sums(chunk: pa.Table, totals: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        place = totals.column("place").to_numpy()
        total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        total[place], best[place] = totals.column("total").to_numpy(), totals.column("best").to_numpy()
        at = np.frombuffer(chunk.column("places")[0].as_py(), "<u4")
        times = np.frombuffer(chunk.column("times")[0].as_py(), "<u4").astype(np.int64)
        bounds = _bounds(chunk.column("cells")[0].values.to_numpy())
        by_best, by_sum = (np.concatenate([[0], np.cumsum(v[at] * times)]) for v in (best, total))
        lists = {n: chunk.column(n)[0].values for n in ("ids", "n_a", "n_b", "n_groups", "shas")}
        return pa.table({"id": lists["ids"], "n_a": lists["n_a"], "n_b": lists["n_b"], "n_groups": lists["n_groups"], "n_links": lists["n_groups"],
                         "n_best": np.diff(by_best[bounds]), "count_sum": np.diff(by_sum[bounds]), "groups_sha256": lists["shas"]})

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(src.schema["id"].dataType), *[pa.int64()] * 6, pa.string()]
    left = cut.select("chunk", "ids", "n_a", "n_b", "n_groups", "shas", "cells", "places", "times")
    out = left.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(sums, f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", groups_sha256 string")
    return out.withColumnRenamed("id", id_column)


def op11_cross_tokenizer(spark, folder: str) -> DataFrame:
    """Alignment of the byte-level BPE of 50,257 ids with the sentencepiece model of 32,000 ids over all documents."""
    import public_tokenizers
    from tamiz.llm.store import table
    return aligned(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
