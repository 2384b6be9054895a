"""Toxicity: a small convolutional text classifier, trained in numpy.

A word (letters, digits and non-ASCII bytes, lower case) is the sum of hashed embeddings of itself and of its first 4, 5 and 6
bytes, so unseen inflections share weights with seen ones. Filters of widths 1, 2 and 3 run over the whole text; each is
rectified and max-pooled, and a logistic layer reads the pooled values. One embedding channel starts as the smoothed log-odds of
its bucket in the training sample, the others at random; all are trained (Adagrad; only pooled positions carry gradients).

Training uses a bounded sample of labelled rows: about ``sample_rows`` by a hash of the id among those that have a text, half for
each label, and at most ``sample_bytes`` of text, the shortest of each label where that acts and its shortest in any case. The language guess learns from ``guess_rows`` texts of each
language of the sample. Thresholds are calibrated by language over *all* labelled training rows: the language is guessed from
the text alone (nearest centroids of the sample), and the score is the logistic of the distance to that language's threshold, so
0.5 is the cut for every language. Languages with under 20 rows of either label use the threshold of all languages together.

Null and empty texts score as a text without any word. Without labelled rows every score is 0; with one label only, every score
is that label. Ties and repeated rows score alike. Only the named columns are read. A null id is never a training row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm import langid
from tamiz.llm import words as W
from tamiz.llm.sampling import labelled_texts
from tamiz.llm.store import crc32_of_id, stored

BUCKETS = 1 << 16
DIM = 12
FILTERS = 12
WIDTHS = (1, 2, 3)
HEADS = (4, 5, 6)
PAD = max(WIDTHS) - 1

_PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Net:
    embedding: np.ndarray  # BUCKETS x DIM
    kernels: list[np.ndarray]  # for each width: width x DIM x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float

    def scores(self, buckets: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
        """Logit of each text."""
        pooled = pool(self, buckets, text_of, n)[0]
        return pooled @ self.out + self.bias


def buckets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets (words x 4) and text number of every word."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    data, offsets = W.utf8(pc.utf8_lower(column))
    starts, ends, text_of = W.word_spans(data, offsets, _PARTS)
    keys = [W.span_hashes(data, starts, ends)] + [W.span_hashes(data, starts, np.minimum(ends, starts + h)) + np.uint64(h) for h in HEADS]
    return np.stack([(W.mix(k) % np.uint64(BUCKETS)).astype(np.int32) for k in keys], axis=1).reshape(-1, 1 + len(HEADS)), text_of


def pool(net: Net, buckets: np.ndarray, text_of: np.ndarray, n: int, places: bool = False):
    """Max-pooled filter values of each text, and with ``places`` the row behind each. Twice ``PAD`` blank rows follow each text:
    windows start at its words and at the first ``PAD`` of them, so none reaches the next text, and a text without words has some."""
    lengths = np.bincount(text_of, minlength=n)
    begin = np.concatenate([[0], np.cumsum(lengths + 2 * PAD)])
    row = np.arange(len(buckets)) + text_of * 2 * PAD
    outside = (begin[1:, None] - np.arange(1, PAD + 1)).ravel()
    x = np.zeros((begin[-1] + PAD, DIM), np.float32)
    e = net.embedding[buckets[:, 0]]
    for k in range(1, buckets.shape[1]):
        e += net.embedding[buckets[:, k]]
    x[row] = e
    total = begin[-1]
    values, where = [], []
    for width, kernel, bias in zip(WIDTHS, net.kernels, net.biases):
        z = x[:total] @ kernel[0]
        for j in range(1, width):
            z += x[j:total + j] @ kernel[j]
        z = np.maximum(z + bias, 0)
        z[outside] = 0
        if n:
            values.append(np.maximum.reduceat(z, begin[:-1], axis=0))
        if places:
            where.append(np.stack([begin[t] + z[begin[t]:begin[t + 1]].argmax(axis=0) for t in range(n)]))
    pooled = np.concatenate(values, axis=1) if n else np.zeros((0, FILTERS * len(WIDTHS)), np.float32)
    return pooled, where, x, row


def train(texts: list[str], labels: np.ndarray, epochs: int = 4, batch: int = 32, rate: float = 0.05, seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    parts = [buckets_of(pa.array(texts[a:a + 256], pa.large_string())) + (a,) for a in range(0, len(texts), 256)]
    all_buckets = np.concatenate([p[0] for p in parts])
    text_of = np.concatenate([p[1] + p[2] for p in parts])
    bounds = np.searchsorted(text_of, np.arange(len(texts) + 1))
    embedding = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    seen = np.unique(np.repeat(text_of.astype(np.int64), all_buckets.shape[1]) * BUCKETS + all_buckets.ravel())
    of_label = labels[seen // BUCKETS]
    per = [np.bincount(seen[of_label == y] % BUCKETS, minlength=BUCKETS) for y in (0, 1)]
    odds = np.log((per[1] + 0.5) / (labels.sum() + 1)) - np.log((per[0] + 0.5) / ((1 - labels).sum() + 1))
    # A bucket seen in few texts tells little either way.
    embedding[:, 0] = (odds * np.minimum(1, (per[0] + per[1]) / 20) / 4).astype(np.float32)
    kernels = [rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for kernel in kernels:
        kernel[:, 0, :] = np.abs(kernel[:, 0, :]) + 0.3
    net = Net(embedding, kernels, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.1, np.float32), -1.0)
    g_emb = np.full((BUCKETS, DIM), 1e-4, np.float32)
    g_ker = [np.full_like(k, 1e-4) for k in net.kernels]
    g_bia = [np.full_like(b, 1e-4) for b in net.biases]
    g_out, g_b = np.full_like(net.out, 1e-4), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            docs = order[at:at + batch]
            pieces = [np.arange(bounds[d], bounds[d + 1]) for d in docs]
            rows = np.concatenate(pieces)
            local = np.repeat(np.arange(len(docs)), [len(p) for p in pieces])
            mine = all_buckets[rows]
            pooled, where, x, row = pool(net, mine, local, len(docs), places=True)
            p = 1 / (1 + np.exp(-(pooled @ net.out + net.bias)))
            delta = ((p - labels[docs]) / len(docs)).astype(np.float32)
            d_out = pooled.T @ delta
            d_pool = np.outer(delta, net.out) * (pooled > 0)
            g_out += d_out ** 2
            g_b += float(delta.sum()) ** 2
            x_rows, x_grads = [], []
            for k, (width, kernel) in enumerate(zip(WIDTHS, net.kernels)):
                d = d_pool[:, k * FILTERS:(k + 1) * FILTERS]
                d_bias = d.sum(axis=0)
                d_kernel = np.empty_like(kernel)
                for j in range(width):
                    taken = x[where[k] + j]  # texts x FILTERS x DIM
                    d_kernel[j] = np.einsum("tf,tfd->df", d, taken)
                    x_rows.append((where[k] + j).ravel())
                    x_grads.append((d[:, :, None] * kernel[j].T[None]).reshape(-1, DIM))
                g_ker[k] += d_kernel ** 2
                g_bia[k] += d_bias ** 2
                net.kernels[k] = kernel - rate * d_kernel / np.sqrt(g_ker[k])
                net.biases[k] = net.biases[k] - rate * d_bias / np.sqrt(g_bia[k])
            net.out = net.out - rate * d_out / np.sqrt(g_out)
            net.bias -= rate * float(delta.sum()) / g_b ** 0.5
            back = np.full(len(x), -1)
            back[row] = np.arange(len(row))
            hit, grads = back[np.concatenate(x_rows)], np.concatenate(x_grads)
            fine = hit >= 0
            cells = mine[hit[fine]].ravel()
            used, slot = np.unique(cells, return_inverse=True)
            d_emb = np.zeros((len(used), DIM), np.float32)
            np.add.at(d_emb, slot, np.repeat(grads[fine], mine.shape[1], axis=0))
            g_emb[used] += d_emb ** 2
            net.embedding[used] -= rate * d_emb / np.sqrt(g_emb[used])
    return net


def guesser(rows: list, most: int | None = 400) -> langid.Model:
    """Centroids of the languages of the sample, for a guess from the text alone: from the first ``most`` texts of each language,
    None for all."""
    by: dict[str, list[str]] = {}
    for r in rows:
        if r["lang"] is not None:
            by.setdefault(r["lang"], []).append(r["text"])
    langs = sorted(by, key=lambda x: (-len(by[x]), x))
    if not langs:
        return langid.Model()
    found = {x: langid.counts(pa.array(by[x][:most], pa.large_string())) for x in langs}
    df = sum((f > 0).sum(axis=0) for f in found.values())
    idf = (np.log((1 + sum(map(len, found.values()))) / (1 + df)) + 1).astype(np.float32)
    centres = [langid.cluster(langid.weighted(found[x], idf), 2) for x in langs]
    return langid.Model(langs, idf, np.vstack(centres).astype(np.float32), np.repeat(np.arange(len(langs)), [len(c) for c in centres]))


def logits(docs: DataFrame, net: Net, model: langid.Model) -> DataFrame:
    """``(id, logit, guess)`` of every document ``(id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast((net, model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, model = shared.value
        for piece in W.slices(batches, "text", rows=langid.ROWS):
            column = piece.column(1)
            buckets, text_of = buckets_of(column)
            guess = [""] * len(column)
            if model.langs:
                guess = [model.langs[k] for k in langid.nearest(model, langid.counts(column))[0]]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(net.scores(buckets, text_of, len(column)).astype(np.float64)), pa.array(guess, pa.string())],
                                             names=["id", "logit", "guess"])

    return docs.select("id", "text").mapInArrow(work, f"id {docs.schema['id'].dataType.simpleString()}, logit double, guess string")


def calibrate(scored: DataFrame, labelled: DataFrame, steps: int = 20) -> dict[str, float]:
    """Threshold by guessed language from the logits of all labelled rows, in steps of ``1 / steps``; ``""`` is all together."""
    cells = (scored.join(labelled, "id").groupBy("guess", "toxic", F.floor(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), "logit")) * steps).cast("int").alias("bin"))
             .count().collect())
    groups: dict[str, list] = {"": cells}
    for r in cells:
        if r["guess"]:
            groups.setdefault(r["guess"], []).append(r)
    out = {}
    for lang, rows in groups.items():
        size = [sum(r["count"] for r in rows if r["toxic"] == y) for y in (0, 1)]
        if lang and min(size) < 20 or not min(size):
            continue
        # A bin's rows all lie on one side of any cut between bins, so the counts are enough.
        bins = sorted({r["bin"] for r in rows})
        toxic = {b: sum(r["count"] for r in rows if r["bin"] == b and r["toxic"] == 1) for b in bins}
        clean = {b: sum(r["count"] for r in rows if r["bin"] == b and r["toxic"] == 0) for b in bins}
        below_t, above_c = 0.0, float(size[0])
        errors = []
        for b in bins[:-1]:
            below_t += toxic[b]
            above_c -= clean[b]
            errors.append(below_t / size[1] + above_c / size[0])
        if errors:
            k = max((k for k, e in enumerate(errors) if e <= min(errors) + 1e-12), key=lambda k: bins[k + 1] - bins[k])
            out[lang] = (bins[k] + 1 + bins[k + 1]) / 2 / steps
    return out


def toxicity(docs: DataFrame, labels: DataFrame, training=None, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
             label_column: str = "toxic", sample_rows: int = 4000, sample_bytes: int = 32 << 20,
             guess_rows: int | None = 400) -> DataFrame:
    """``(id, score)`` of every document. ``training``: condition on the label rows that may be learned from."""
    labelled = (labels.where(F.lit(True) if training is None else training).select(labels[id_column].alias("id"), F.col(label_column).cast("int").alias("toxic"))
                .where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic")))
    src = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"), docs[lang_column].alias("lang"))
    rows = labelled_texts(src, labelled.withColumnRenamed("toxic", "label"), "toxicity", sample_rows, sample_bytes)
    y = np.array([r["label"] for r in rows], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return src.select(F.col("id").alias(id_column), F.lit(float(y[0]) if len(y) else 0.0).alias("score"))
    scored = stored(logits(src, train([r["text"] for r in rows], y), guesser(rows)), "toxicity")
    cuts = calibrate(scored, labelled)
    overall = cuts.pop("", 0.0)
    cut = F.lit(overall)
    if cuts:
        cut = F.coalesce(F.element_at(F.create_map(*[x for k, v in sorted(cuts.items()) for x in (F.lit(k), F.lit(v))]), F.col("guess")), cut)
    return scored.select(F.col("id").alias(id_column), (1 / (1 + F.exp(cut - F.col("logit")))).alias("score"))


def op3_toxicity(spark, folder: str) -> DataFrame:
    """Toxicity score of every document; learned from label rows where the id's checksum is not 0 mod 5."""
    from tamiz.llm.store import table
    held = crc32_of_id() % 5 == 0
    found = toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
