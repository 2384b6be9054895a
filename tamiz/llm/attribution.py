"""Token counts by field or section: every document is encoded once, as a whole, and its tokens are handed to sections.

Tokens carry character spans. Sections are character intervals of the same text, in order and apart from one another; gaps
between them are allowed. The join of the two interval lists is a pair of binary searches for each document, as both are sorted.
A token that lies in one section is that section's. A token that crosses boundaries is allocated by the rule:

* ``majority``: the section that holds most of its characters, of equal ones the earlier;
* ``start``: the section that holds its first character, else (first character in a gap) the first it reaches.

A token that touches no section is counted under section ``-1``. An empty section has no tokens. So the counts of a document add
up to the tokens of its whole text, which counting each section on its own does not give.

:func:`count_sections` cuts texts by a function (:func:`line_sections` by default); :func:`count_fields` counts string columns
that are joined into one text by a separator. Null text or field counts as empty. Repeated rows are counted one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm import words as W
from tamiz.llm.tokens import stretches

NOWHERE = -1


def line_sections(text: str) -> np.ndarray:
    """One section for each line; a line break belongs to the line that it ends. An empty text is one empty section."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    cuts = np.flatnonzero(raw == 10) + 1
    ends = np.append(cuts, len(raw)) if not len(cuts) or cuts[-1] != len(raw) or not len(raw) else cuts
    return np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1).astype(np.int64)


def attribute(spans: np.ndarray, sections: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """For each token: its section (or -1), and whether it reaches into more than one."""
    if rule not in ("majority", "start"):
        raise ValueError(f"unknown rule {rule!r}")
    if not len(sections):
        return np.full(len(spans), NOWHERE), np.zeros(len(spans), bool)
    # Empty sections hold no characters, so they take no part in the search.
    real = np.flatnonzero(sections[:, 1] > sections[:, 0])
    begins, ends = sections[real, 0], sections[real, 1]
    first = np.searchsorted(ends, spans[:, 0], side="right")
    last = np.searchsorted(begins, spans[:, 1], side="left") - 1
    crossing = last > first
    owner = np.where(last >= first, first, NOWHERE)
    if rule == "majority":
        for k in np.flatnonzero(crossing):
            a, b = spans[k]
            held = [min(b, ends[j]) - max(a, begins[j]) for j in range(first[k], last[k] + 1)]
            owner[k] = first[k] + int(np.argmax(held))
    return np.where(owner >= 0, np.append(real, NOWHERE)[owner], NOWHERE), crossing


def _rows(texts: list[str], cuts: list[np.ndarray], encoder, rule: str):
    """Document number, section number, start, end, tokens and crossing tokens, one row for each section."""
    out = []
    for n, (spans, sections) in enumerate(zip(encoder.spans(texts), cuts)):
        owner, crossing = attribute(spans, sections, rule)
        size = len(sections)
        counts = np.bincount(owner + 1, minlength=size + 1)
        crossed = np.bincount((owner + 1)[crossing], minlength=size + 1)
        numbers = np.arange(-1 if counts[0] else 0, size)
        bounds = np.vstack([[[0, 0]], sections]) if size else np.zeros((1, 2), np.int64)
        out.append(np.column_stack([np.full(len(numbers), n), numbers, bounds[numbers + 1], counts[numbers + 1], crossed[numbers + 1]]))
    return np.concatenate(out) if out else np.zeros((0, 6), np.int64)


def count_sections(docs: DataFrame, tokenizer_path: str, cut: Callable[[str], np.ndarray] = line_sections, rule: str = "majority",
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, section, start, end, n_tokens, n_crossing)`` of every section of every document."""
    src = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = stretches(tokenizer_path, True)
        for part in W.slices(batches, "text"):
            texts = [t or "" for t in part.column(1).to_pylist()]
            got = _rows(texts, [cut(t) for t in texts], encoder, rule)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(got[:, 0])), pa.array(got[:, 1], pa.int32()), *[pa.array(got[:, k], pa.int64()) for k in range(2, 6)]],
                                             names=["id", "section", "start", "end", "n_tokens", "n_crossing"])

    return (src.mapInArrow(work, f"id {src.schema['id'].dataType.simpleString()}, section int, start long, end long, n_tokens long, n_crossing long")
            .withColumnRenamed("id", id_column))


def count_fields(rows: DataFrame, fields: list[str], tokenizer_path: str, separator: str = "\n", rule: str = "majority", id_column: str = "doc_id") -> DataFrame:
    """``(id, field, n_tokens, n_crossing)``: tokens of each column when the columns are one text. Separators are the gaps:
    what no field holds is counted under a null field."""
    parts = [F.coalesce(rows[f].cast("string"), F.lit("")) for f in fields]
    src = rows.select(rows[id_column].alias("id"), F.array_join(F.array(*parts), separator).alias("text"), *[F.char_length(p).alias(f"n{k}") for k, p in enumerate(parts)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = stretches(tokenizer_path, True)
        for part in W.slices(batches, "text"):
            sizes = np.column_stack([part.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(fields))])
            begins = np.cumsum(sizes + len(separator), axis=1) - sizes - len(separator)
            cuts = [np.column_stack([b, b + s]).astype(np.int64) for b, s in zip(begins, sizes)]
            got = _rows(part.column(1).to_pylist(), cuts, encoder, rule)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(got[:, 0])), pa.array([fields[k] if k >= 0 else None for k in got[:, 1]], pa.string()),
                                              pa.array(got[:, 4], pa.int64()), pa.array(got[:, 5], pa.int64())], names=["id", "field", "n_tokens", "n_crossing"])

    return (src.mapInArrow(work, f"id {src.schema['id'].dataType.simpleString()}, field string, n_tokens long, n_crossing long")
            .withColumnRenamed("id", id_column))


def op6_token_counts(spark, folder: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of the whole document."""
    import public_tokenizers

    from tamiz.llm.store import table
    return count_sections(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
