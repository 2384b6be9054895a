"""Language identification by nearest centroid.

A text becomes a vector of hashed byte 2- and 3-grams (lower case, ASCII characters other than letters as blanks), weighted
``(1 + log tf) * idf`` and scaled to length 1. Each language has up to ``clusters`` centroids from spherical k-means; the
language of the nearest centroid by cosine is predicted.

Fitting: document frequencies are counted over all training rows. Centroids come from a sample of training rows of at most about
``sample_rows`` in all, an equal part for each language, chosen by a hash of the id (a language with fewer rows gives them all).
Rejection: for each language and size class of text (log2 of its different n-grams), the cosines of all training rows give the
``tail`` quantile; a text whose cosine is under ``slack`` times it is too far from every centroid and is rejected. Size classes
with under 100 training rows, too few to tell a tail, use half of the language's cut-off over all its rows.

Null texts, and texts without a letter, are ``und`` with score 0 and rejected. A text without any n-gram that the model knows
goes to the language with most training rows, with score 0. Null languages are not learned; with no training row at all, every
text is ``und``. Ties go to the language with more training rows, then the smaller name. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm import words as W
from tamiz.llm.store import bounded_batches, crc32_of_id, stored

BITS = 14
BUCKETS = 1 << BITS
#: Texts whose vectors a task holds at once.
ROWS = 64
UNKNOWN = "und"

_CLEAN = np.arange(256, dtype=np.uint32)
_CLEAN[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    centroids: np.ndarray | None = None  # one row for each centroid
    owner: np.ndarray | None = None  # the language number of each centroid
    cutoffs: dict[tuple[str, int], float] = field(default_factory=dict)


def counts(column: pa.Array) -> np.ndarray:
    """Hashed n-gram counts, one row for each text."""
    column = column.cast(pa.large_string())
    data, offsets = W.utf8(pc.utf8_lower(pc.fill_null(column, "")))
    n = len(column)
    out = np.zeros((n, BUCKETS), np.float32)
    if not len(data):
        return out
    b = _CLEAN[data]
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    ends = offsets[1:][text_of]
    place = np.arange(len(b))
    for size in (2, 3):
        if len(b) < size:
            continue
        key = np.zeros(len(b) - size + 1, np.uint32)
        for j in range(size):
            key = key * np.uint32(0x01000193) + b[j:len(b) - size + 1 + j] + np.uint32(1)
        key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        fits = place[:len(key)] + size <= ends[:len(key)]
        out += np.bincount(text_of[:len(key)][fits] * BUCKETS + key[fits], minlength=n * BUCKETS).reshape(n, BUCKETS)
    return out


def packed(row: np.ndarray) -> bytes:
    """The buckets that a text has, and their counts."""
    used = np.flatnonzero(row)
    return np.stack([used, np.minimum(row[used], 65535)]).astype("<u2").tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for k, raw in enumerate(rows):
        used, times = np.frombuffer(raw, "<u2").reshape(2, -1)
        out[k, used] = times
    return out


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows, cols = np.nonzero(found)
    out = np.zeros_like(found, dtype=np.float32)
    out[rows, cols] = (1 + np.log(found[rows, cols])) * idf[cols]
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.maximum(norm, 1e-12)[:, None]


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: first centres by farthest point from the mean direction, so reruns agree."""
    def unit(m):
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    centres = unit(vectors.mean(axis=0, keepdims=True))
    while len(centres) < min(k, len(vectors)):
        far = int(np.argmin((vectors @ centres.T).max(axis=1)))
        centres = np.vstack([centres, unit(vectors[far:far + 1])])
    for _ in range(rounds):
        near = np.argmax(vectors @ centres.T, axis=1)
        sums = np.stack([vectors[near == j].sum(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))])
        new = unit(sums)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


def fit(training: DataFrame, clusters: int = 4, sample_rows: int = 3000, id_column: str = "doc_id", text_column: str = "text",
        lang_column: str = "lang") -> Model:
    """Learn from all rows of ``training`` with a language."""
    rows = training.select(training[id_column].alias("id"), training[text_column].alias("text"), training[lang_column].alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model()
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    part = max(1, sample_rows // len(langs))
    share = F.element_at(F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, part / sizes[lang])))]), F.col("lang"))
    drawn = (F.xxhash64("id") / F.lit(2.0 ** 64) + 0.5) < share

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        for piece in W.slices(batches, "text", rows=ROWS):
            found = counts(piece.column("text"))
            df += (found > 0).sum(axis=0)
            take = np.flatnonzero(piece.column("drawn").to_numpy(zero_copy_only=False))
            if len(take):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece.column("lang")[int(k)].as_py() for k in take], pa.string()), pa.nulls(len(take), pa.int32()), pa.nulls(len(take), pa.int64()),
                     pa.array([packed(found[k]) for k in take], pa.binary())], names=["lang", "bucket", "df", "vector"])
        full = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.string()), pa.array(full, pa.int32()), pa.array(df[full], pa.int64()), pa.nulls(len(full), pa.binary())],
                                         names=["lang", "bucket", "df", "vector"])

    seen = stored(rows.withColumn("drawn", drawn).select("text", "lang", "drawn").mapInArrow(count, "lang string, bucket int, df long, vector binary"), "langid-fit")
    df = np.zeros(BUCKETS)
    for r in seen.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[r["bucket"]] = r["df"]
    idf = (np.log((1 + sum(sizes.values())) / (1 + df)) + 1).astype(np.float32)
    sample = seen.where("lang IS NOT NULL").select("lang", "vector").collect()
    centroids, owner = [], []
    for n, lang in enumerate(langs):
        mine = sorted(bytes(r["vector"]) for r in sample if r["lang"] == lang)
        if mine:
            found = cluster(weighted(unpacked(mine), idf), clusters)
            centroids.append(found)
            owner += [n] * len(found)
    if not owner:
        return Model()
    return Model(langs, idf, np.vstack(centroids).astype(np.float32), np.array(owner))


def nearest(model: Model, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language number and cosine of the nearest centroid."""
    cosine = weighted(found, model.idf) @ model.centroids.T
    best = np.argmax(cosine, axis=1)
    return model.owner[best], np.clip(cosine[np.arange(len(best)), best], 0, 1)


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``(id, lang_pred, score, size_class)`` and the columns of ``keep``."""
    keep = keep or []
    src = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"), *[docs[c] for c in keep])
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[2:])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.slices(batches, "text", rows=ROWS):
            text = piece.column(1).cast(pa.large_string())
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            langs, scores = np.full(len(text), -1), np.zeros(len(text))
            found = counts(text)
            if model.langs:
                langs, scores = nearest(model, found)
            names = [model.langs[k] if ok and k >= 0 else UNKNOWN for k, ok in zip(langs, letters)]
            size_class = np.log2(1 + (found > 0).sum(axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([piece.column(0), *[piece.column(k) for k in range(2, 2 + len(keep))], pa.array(names, pa.string()),
                                              pa.array(np.where(letters, scores, 0.0), pa.float64()), pa.array(size_class, pa.int32())],
                                             names=["id", *keep, "lang_pred", "score", "size_class"])
        W.release()

    return (src.mapInArrow(work, f"id {src.schema['id'].dataType.simpleString()}{extra}, lang_pred string, score double, size_class int")
            .withColumnRenamed("id", id_column))


def calibrate(predicted: DataFrame, training, tail: float = 0.002, slack: float = 0.9) -> dict[tuple[str, int], float]:
    """Cut-off cosine for each language and size class, from the cosines of all rows that ``training`` (a condition) marks."""
    bins = (predicted.where(training).where(F.col("lang_pred") != UNKNOWN)
            .groupBy("lang_pred", "size_class", F.floor(F.col("score") * 500).cast("int").alias("bin")).count().collect())
    tables: dict[tuple[str, int], np.ndarray] = {}
    for r in bins:
        tables.setdefault((r["lang_pred"], r["size_class"]), np.zeros(501, np.int64))[r["bin"]] += r["count"]
    def cut(table: np.ndarray) -> float:
        return slack * int(np.searchsorted(np.cumsum(table), tail * table.sum(), side="right")) / 500

    out = {k: cut(t) for k, t in tables.items() if t.sum() >= 100}
    for lang in {k[0] for k in tables}:
        pooled = cut(sum(t for k, t in tables.items() if k[0] == lang)) / 2
        for size in range(14):
            out.setdefault((lang, size), pooled)
    return out


def identified(docs: DataFrame, training=None, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns. Rows are judged in place: nothing is joined by id."""
    bounded_batches(docs.sparkSession)
    training = F.lit(True) if training is None else training
    model = fit(docs.where(training), id_column=id_column, text_column=text_column, lang_column=lang_column)
    marked = docs.where(F.coalesce(training & docs[lang_column].isNotNull(), F.lit(False)))
    cutoffs = calibrate(stored(predict(marked, model, id_column, text_column), "langid"), F.lit(True))
    place = docs.columns.index(text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.slices(batches, text_column, rows=ROWS):
            text = piece.column(place).cast(pa.large_string())
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            stays = np.zeros(len(text), bool)
            if model.langs:
                found = counts(text)
                langs, scores = nearest(model, found)
                sizes = np.log2(1 + (found > 0).sum(axis=1)).astype(int).tolist()
                stays = letters & np.array([s >= cutoffs.get((model.langs[k], z), 0.0) for k, s, z in zip(langs, scores, sizes)], bool)
            yield piece.filter(pa.array(stays))
        W.release()

    return docs.mapInArrow(work, docs.schema)


def identify(docs: DataFrame, training=None, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Fit on the rows that ``training`` (a condition; all rows when None) marks, and give every document
    ``lang_pred, score, rejected``."""
    training = F.lit(True) if training is None else training
    model = fit(docs.where(training), id_column=id_column, text_column=text_column, lang_column=lang_column)
    marked = docs.withColumn("__training", F.coalesce(training & docs[lang_column].isNotNull(), F.lit(False)))
    found = stored(predict(marked, model, id_column, text_column, ["__training", *(keep or [])]), "langid")
    cutoffs = calibrate(found, F.col("__training"))
    rejected = F.col("lang_pred") == UNKNOWN
    if cutoffs:
        cut = F.create_map(*[x for (lang, size), v in sorted(cutoffs.items()) for x in (F.lit(f"{lang} {size}"), F.lit(v))])
        rejected = rejected | F.coalesce(F.col("score") < F.element_at(cut, F.concat_ws(" ", "lang_pred", "size_class")), F.lit(False))
    return found.withColumn("rejected", rejected).drop("__training", "size_class")


def op2_language_id(spark, folder: str) -> DataFrame:
    """Predicted language of every document; learned where the id's checksum is not 2 mod 4."""
    from tamiz.llm.store import table
    held = crc32_of_id() % 4 == 2
    docs = table(spark, folder, "documents")
    return identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
