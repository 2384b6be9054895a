"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector ``x``: a bucket for each of its distinct words (letters, digits and non-ASCII bytes, lower case; values are
square roots of the counts, scaled to length ``WORDS``), one bucket for each structure statistic (the bin that its value falls
into; edges are quantiles of either label's training sample) and one for each metadata column (likewise, nulls in a bin of their own). The
machine scores ``bias + <w, x> + sum over pairs of <v_i, v_j> x_i x_j``. The sum over all pairs is never formed: for each factor it is
half of ``(sum v x)^2 - sum (v x)^2``, so a text takes time linear in its distinct words.

Training is Adagrad on the logistic loss (both labels weigh the same) in numpy, over a bounded sample of labelled rows: about ``sample_rows`` by a hash of the id
among those that have a text, half for each label, and at most ``sample_bytes`` of text, the shortest of each label where that
acts. The cut is calibrated over *all* labelled training rows (least sum of both labels' error rates, the middle of the widest gap)
and taken off the score before the logistic function, so 0.5 is the cut.

Null and empty texts score as a text without words. Without labelled texts every score is 0; with one label only, every score is
that label. Ties and repeated rows score alike; a null id is never a training row. Only the named columns are read. Metadata
columns are numbers; labels, ids, languages and sources are no inputs unless named as metadata.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm import words as W
from tamiz.llm.sampling import labelled_texts
from tamiz.llm.store import crc32_of_id, stored

BUCKETS, FACTORS, BINS = 1 << 15, 8, 10
#: Length of the vector of words beside that of the statistics, which is one.
WORDS = 0.1
_PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Byte classes whose shares of a text are statistics.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "mark": b"!?", "stop": b".,;:", "blank": b" \t\r", "line": b"\n",
           "other": b"\"'()+-/=@[\\]^_`{}~", "wide": bytes(range(128, 256))}
_OF_CLASS = np.zeros((len(CLASSES), 256), bool)
for _k, _members in enumerate(CLASSES.values()):
    _OF_CLASS[_k, list(_members)] = True
STATISTICS = [*CLASSES, "bytes", "words", "word length", "distinct words", "commonest word", "words said again", "repeated lines", "line length"]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def described(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Structure statistics (texts x statistics), and the text, bucket and value of each distinct word of a text."""
    data, offsets = W.utf8(column)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    counts = []
    for members in _OF_CLASS:
        sums = np.concatenate([[0], np.cumsum(members[data], dtype=np.int64)])
        counts.append(sums[offsets[1:]] - sums[offsets[:-1]])
    low, low_offsets = W.utf8(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    starts, ends, text_of = W.word_spans(low, low_offsets, _PARTS)
    keys = W.span_hashes(low, starts, ends)
    again = text_of[1:][(keys[1:] == keys[:-1]) & (text_of[1:] == text_of[:-1])]
    cell, times = np.unique(text_of * BUCKETS + (W.mix(keys) % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    of, bucket, values = cell // BUCKETS, cell % BUCKETS, np.sqrt(times)
    values = values / np.sqrt(np.maximum(1e-9, np.bincount(of, values ** 2, n)))[of]
    n_words, commonest = np.bincount(text_of, minlength=n), np.zeros(n, np.int64)
    np.maximum.at(commonest, of, times)
    broken = np.zeros(256, bool)
    broken[10] = True
    begin, end, line_of = W.word_spans(data, offsets, broken)
    lines = np.bincount(line_of, minlength=n)
    distinct = np.unique(np.stack([line_of.astype(np.uint64), W.span_hashes(data, begin, end)], axis=1), axis=0)[:, 0].astype(np.int64) if len(begin) else np.zeros(0, np.int64)
    stats = [_ratio(c, sizes) for c in counts] + [
        np.log1p(sizes), np.log1p(n_words), _ratio(np.bincount(text_of, ends - starts, n), n_words), _ratio(np.bincount(of, minlength=n), n_words),
        _ratio(commonest, n_words), _ratio(np.bincount(again, minlength=n), n_words), 1 - _ratio(np.bincount(distinct, minlength=n), lines), np.log1p(_ratio(sizes, lines))]
    return np.stack(stats, axis=1), of, bucket, values


@dataclass
class Machine:
    edges: list[np.ndarray]  # of each statistic, then of each metadata column
    bias: float
    linear: np.ndarray  # buckets, then bins
    factors: np.ndarray  # as many rows, FACTORS columns

    def vectors(self, column: pa.Array, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature and value of all entries. ``metadata``: texts x columns, NaN for null."""
        stats, of, bucket, values = described(column)
        known = np.concatenate([stats, metadata], axis=1)
        bins = [np.where(np.isnan(known[:, k]), len(e) + 1, np.searchsorted(e, known[:, k])) for k, e in enumerate(self.edges)]
        placed = [BUCKETS + k * (BINS + 2) + b for k, b in enumerate(bins)]
        n, share = len(stats), 1 / np.sqrt(len(placed))
        return (np.concatenate([of, np.tile(np.arange(n), len(placed))]), np.concatenate([bucket, *placed]),
                np.concatenate([WORDS * values, np.full(n * len(placed), share)]))

    def logits(self, of: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(of, self.linear[feature] * value, n)
        for f in range(FACTORS):
            term = self.factors[feature, f] * value
            out += 0.5 * (np.bincount(of, term, n) ** 2 - np.bincount(of, term ** 2, n))
        return out


def empty_machine(column: pa.Array, metadata: np.ndarray, labels: np.ndarray) -> Machine:
    """Untrained, with the bins' edges taken from a sample: the same quantiles of either label, so the rarer one has edges too."""
    known = np.concatenate([described(column)[0], metadata], axis=1)
    inner = np.arange(1, 1 + BINS // 2) / (1 + BINS // 2)

    def quantiles(values: np.ndarray) -> np.ndarray:
        values = values[~np.isnan(values)]
        return np.quantile(values, inner) if len(values) else np.zeros(0)

    edges = [np.unique(np.concatenate([quantiles(c[labels == y]) for y in (0, 1)])) for c in known.T]
    size = BUCKETS + len(edges) * (BINS + 2)
    return Machine(edges, 0.0, np.zeros(size), np.random.default_rng(11).normal(0, 0.05, (size, FACTORS)))


def train(texts: list[str], labels: np.ndarray, metadata: np.ndarray, epochs: int = 20, batch: int = 32, rate: float = 0.1, decay: float = 1e-3, seed: int = 5) -> Machine:
    column = pa.array(texts, pa.large_string())
    machine = empty_machine(column, metadata, labels)
    of, feature, value = machine.vectors(column, metadata)
    order = np.argsort(of, kind="stable")
    feature, value = feature[order], value[order]
    bounds = np.searchsorted(of[order], np.arange(len(texts) + 1))
    squares, squares_w, square_b = np.full_like(machine.factors, 1e-4), np.full_like(machine.linear, 1e-4), 1e-4
    weight = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))[labels]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        turn = rng.permutation(len(texts))
        for at in range(0, len(turn), batch):
            rows = turn[at:at + batch]
            cells = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
            text = np.repeat(np.arange(len(rows)), bounds[rows + 1] - bounds[rows])
            f, x = feature[cells], value[cells]
            term = machine.factors[f] * x[:, None]
            sums = np.zeros((len(rows), FACTORS))
            np.add.at(sums, text, term)
            logit = machine.bias + np.bincount(text, machine.linear[f] * x, len(rows)) + 0.5 * ((sums ** 2).sum(axis=1) - np.bincount(text, (term ** 2).sum(axis=1), len(rows)))
            delta = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels[rows]) * weight[rows] / len(rows)
            used, slot = np.unique(f, return_inverse=True)
            d_w = np.bincount(slot, delta[text] * x, len(used)) + decay * machine.linear[used]
            d_v = np.zeros((len(used), FACTORS))
            np.add.at(d_v, slot, (delta[text] * x)[:, None] * (sums[text] - term))
            d_v += decay * machine.factors[used]
            squares_w[used] += d_w ** 2
            squares[used] += d_v ** 2
            square_b += float(delta.sum()) ** 2
            machine.linear[used] -= rate * d_w / np.sqrt(squares_w[used])
            machine.factors[used] -= rate / 4 * d_v / np.sqrt(squares[used])
            machine.bias -= rate * float(delta.sum()) / square_b ** 0.5
    return machine


def _metadata(columns: list) -> np.ndarray:
    return np.stack([np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64) for c in columns], axis=1)


def logits(docs: DataFrame, machine: Machine, metadata: list[str]) -> DataFrame:
    """``(id, logit)`` of every row of ``(id, text, metadata ...)``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.slices(batches, "text"):
            known = _metadata(piece.columns[2:]) if piece.num_columns > 2 else np.zeros((piece.num_rows, 0))
            found = shared.value.logits(*shared.value.vectors(piece.column(1), known), piece.num_rows)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found)], names=["id", "logit"])

    return docs.select("id", "text", *metadata).mapInArrow(work, f"id {docs.schema['id'].dataType.simpleString()}, logit double")


def cut_of(scored: DataFrame, labelled: DataFrame, steps: int = 20) -> float:
    """The logit that parts the labels best over all labelled rows, in steps of ``1 / steps``."""
    held = F.floor(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), "logit")) * steps).cast("int")
    rows = scored.join(labelled, "id").groupBy("label", held.alias("bin")).count().collect()
    bins = sorted({r["bin"] for r in rows})
    count = {y: np.zeros(len(bins)) for y in (0, 1)}
    for r in rows:
        count[r["label"]][bins.index(r["bin"])] = r["count"]
    if len(bins) < 2 or not count[0].sum() or not count[1].sum():
        return 0.0
    # Behind each bin but the last: the share of label 1 below, and of label 0 above.
    errors = (np.cumsum(count[1]) / count[1].sum() + 1 - np.cumsum(count[0]) / count[0].sum())[:-1]
    best = max(np.flatnonzero(errors <= errors.min() + 1e-12), key=lambda k: bins[k + 1] - bins[k])
    return (bins[best] + 1 + bins[best + 1]) / 2 / steps


def quality(docs: DataFrame, labels: DataFrame, training=None, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
            metadata: tuple[str, ...] = (), sample_rows: int = 4000, sample_bytes: int = 32 << 20) -> DataFrame:
    """``(id, score)`` of every document. ``training``: condition on the label rows that may be learned from."""
    labelled = (labels.where(F.lit(True) if training is None else training).select(labels[id_column].alias("id"), F.col(label_column).cast("int").alias("label"))
                .where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label")))
    named = [f"m{k}" for k in range(len(metadata))]
    src = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"), *[docs[c].cast("double").alias(m) for c, m in zip(metadata, named)])
    rows = labelled_texts(src, labelled, "quality", sample_rows, sample_bytes)
    y = np.array([r["label"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return src.select(F.col("id").alias(id_column), F.lit(float(y[0]) if len(y) else 0.0).alias("score"))
    known = np.array([[np.nan if r[m] is None else r[m] for m in named] for r in rows], np.float64).reshape(len(rows), len(named))
    scored = stored(logits(src, train([r["text"] for r in rows], y, known), named), "quality")
    return scored.select(F.col("id").alias(id_column), (1 / (1 + F.exp(F.lit(cut_of(scored, labelled)) - F.col("logit")))).alias("score"))


def op13_quality_classifier(spark, folder: str) -> DataFrame:
    """Quality score of every document; learned from label rows where the id's checksum is not 1 mod 3. Metadata: ``n_chars``."""
    from tamiz.llm.store import table
    held = crc32_of_id() % 3 == 1
    found = quality(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held, metadata=("n_chars",))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
