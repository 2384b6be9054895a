"""Bounded samples of labelled texts, for models that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.store import stored
from tamiz.session import local_rows


def within(sizes: list, most_bytes: int) -> list:
    """Ids of ``(id, label, bytes, draw)`` within ``most_bytes``, the shortest texts of each label first and its shortest in any
    case. A label has half of the bytes, and what the other leaves."""
    total = {y: sum(r["bytes"] for r in sizes if r["label"] == y) for y in (0, 1)}
    out = []
    for y in (0, 1):
        room = max(most_bytes // 2, most_bytes - total[1 - y])
        for k, r in enumerate(sorted((r for r in sizes if r["label"] == y), key=lambda r: (r["bytes"], r["draw"]))):
            room -= r["bytes"]
            if room < 0 and k:
                break
            out.append(r["id"])
    return out


def labelled_texts(docs: DataFrame, labelled: DataFrame, seed: str, sample_rows: int, sample_bytes: int) -> list:
    """Rows of ``docs`` with their ``label`` (0 or 1): about ``sample_rows``, half for each label, within ``sample_bytes``.

    Drawn by a hash of the id among labelled ids that have a text (``docs`` has ``id`` and ``text``, ``labelled`` one row an id), so
    a label that has a text is never missing. Sizes are summed before any text is moved; texts of one id stay or go together."""
    texts = docs.where("text IS NOT NULL AND id IS NOT NULL")
    sizes = texts.groupBy("id").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    known = stored(sizes.join(labelled, "id").select("id", "label", "bytes", F.xxhash64("id", F.lit(seed)).alias("draw")), "labelled")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, sample_rows / 2 / max(1, counts.get(1, 0)))).otherwise(min(1.0, sample_rows / 2 / max(1, counts.get(0, 0))))
    few = known.where(F.col("draw") / F.lit(2.0 ** 64) + 0.5 <= share).collect()
    of = {r["id"]: r["label"] for r in few}
    chosen = local_rows(docs.sparkSession, [(i, of[i]) for i in within(few, sample_bytes)], f"id {docs.schema['id'].dataType.simpleString()}, label int")
    rows = texts.join(F.broadcast(chosen), "id").drop("id").collect()
    return sorted(rows, key=lambda r: (r["text"], r["label"]))
