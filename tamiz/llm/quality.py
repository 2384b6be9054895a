"""Quality rules, line first: judge each line, drop the failing ones, then drop documents that lost too much text.

A line of a document fails when one of these holds (a line without a word is only a gap: it is never judged):

* navigation: menu separators (``|``, ``>``, ``»``, ``•``, ``·``) make up a quarter or more of its words, or it has at most
  ``nav_words`` words, no closing punctuation, and every word is capitalised menu vocabulary of :data:`NAVIGATION`;
* boilerplate: it holds a phrase of :data:`BOILERPLATE`, case ignored;
* punctuation: fewer than half of its characters other than blanks are letters or digits, or one mark (other than ``.``)
  closes most of its words, or it repeats an earlier line of the document (the first one stays).

``kept`` needs the base limits (word count, words in repeated 8-word windows) and that the cleaned text keeps at least
``1 - max_lost`` of the characters other than blanks. A line that merely lacks a full stop is not dropped: titles, verse and
cut-off last lines are clean text.

Null text counts as empty: no words, base failed, not kept. Columns of the input other than the id and the text are not
looked at, so their names may clash with the result's; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm import words as W

WINDOW = 8
NAVIGATION = frozenset("home about contact login logout register search menu help faq sitemap terms privacy next previous back share "
                       "print subscribe blog news shop cart account start inicio contacto accueil startseite kontakt impressum".split())
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "uses cookies",
               "enable javascript", "javascript is disabled", "lorem ipsum", "click here", "sign up for our newsletter", "licensed under the",
               "without warranties or conditions", "permission is hereby granted", "spdx-license-identifier", "tous droits réservés",
               "alle rechte vorbehalten", "todos los derechos reservados")
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
          "n_lines long, n_lines_removed long, kept_share double, clean_text string")

_SYMBOL = re.compile(r"[#*$%&|<>]")
_MARK = re.compile(r"[^\w\s]|_")
_SEPARATORS = frozenset("|>»•·")


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    max_repeat_percent: int = 30
    nav_words: int = 6
    max_lost: float = 0.5


def line_fails(line: str, limits: Limits) -> bool:
    """Whether the rules on a single line (all but the repeat rule) drop it. ``line`` has no blanks at its ends, and a word."""
    marks = len(_MARK.findall(line))
    if marks:
        words = line.count(" ") + line.count("\t") + 1
        # A separator counts as a word of its own, with blanks around it.
        if not _SEPARATORS.isdisjoint(line) and 4 * sum(f" {line} ".count(f" {m} ") for m in _SEPARATORS) >= words:
            return True
        if 2 * marks > len(line) - words + 1:
            return True
        if words >= 5 and 2 * marks > words and any(2 * f"{line} ".count(f"{m} ") > words for m in "!?*#|"):
            return True
    low = line.lower()
    if any(phrase in low for phrase in BOILERPLATE):
        return True
    return (line[-1] not in ".!?…:;" and line.count(" ") < limits.nav_words
            and all(w[:1].isupper() and w.lower() in NAVIGATION for w in line.split()))


def repeat_words(ids: np.ndarray, text_of: np.ndarray, n_texts: int, n: int = WINDOW) -> np.ndarray:
    """Per text, the words that lie in an ``n``-word window found twice or more in it (``n`` a power of two).

    Windows are numbered exactly, by doubling: pairs of words, pairs of pairs, and so on."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.zeros(n_texts, np.int64)
    gram, step = ids.astype(np.int64), 1
    while step < n:
        pair = gram[:-step] * (int(gram.max()) + 1) + gram[step:]
        gram, step = pd.factorize(pair)[0].astype(np.int64), 2 * step
    inside = text_of[:count] == text_of[n - 1:]
    key = gram[:count] * n_texts + text_of[:count]
    number = pd.factorize(key)[0]
    often = np.bincount(number, weights=inside) >= 2
    repeated = inside & often[number]
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    return np.bincount(text_of[np.cumsum(cover[:-1]) > 0], minlength=n_texts)


def judge(texts: list[str | None], limits: Limits, with_text: bool) -> dict[str, list]:
    """All columns of the result for a slice of texts."""
    column = pa.array(texts, pa.large_string())
    data, offsets = W.utf8(column)
    starts, ends, text_of = W.word_spans(data, offsets)
    n = len(texts)
    n_words = np.bincount(text_of, minlength=n)
    # Code points: all bytes but the continuation bytes of UTF-8, none of which is a blank.
    points = np.concatenate([[0], np.cumsum((data & 0xC0 != 0x80) & ~W.BLANK[data])])
    word_chars = points[offsets[1:]] - points[offsets[:-1]]
    raw = data.tobytes()
    ids = pd.factorize(np.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())], dtype=object))[0] if len(starts) else np.zeros(0, np.int64)
    repeats = repeat_words(ids, text_of, n)
    out: dict[str, list] = {name: [] for name in ("n_symbols", "n_dup_lines", "kept", "n_lines", "n_lines_removed", "kept_share", "clean_text")}
    base_failed = (n_words < limits.min_words) | (100 * repeats > limits.max_repeat_percent * n_words)
    for k, text in enumerate(texts):
        text = text or ""
        out["n_symbols"].append(len(_SYMBOL.findall(text)))
        seen: set[str] = set()
        lines, dups, failed, kept_lines = 0, 0, 0, []
        for line in text.split("\n"):
            body = line.strip(" \t\n\x0b\f\r")
            if not body:
                kept_lines.append(line)
                continue
            lines += 1
            again = line in seen
            seen.add(line)
            dups += again
            if again or line_fails(body, limits):
                failed += 1
            else:
                kept_lines.append(line)
        share = 1.0 if lines and not failed else 0.0
        if failed and word_chars[k]:
            share = sum(len(x.translate(_NO_BLANK)) for x in kept_lines) / int(word_chars[k])
        out["n_dup_lines"].append(dups)
        out["n_lines"].append(lines)
        out["n_lines_removed"].append(failed)
        out["kept_share"].append(share)
        out["kept"].append(bool(not base_failed[k] and share >= 1 - limits.max_lost))
        out["clean_text"].append("\n".join(kept_lines) if with_text else None)
    return {"n_words": n_words, "word_chars": word_chars, "n_repeat_words": repeats, "base_failed": base_failed} | out


_NO_BLANK = {ord(c): None for c in " \t\n\x0b\f\r"}


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limits: Limits = Limits(), with_text: bool = True) -> DataFrame:
    """One row per document: the id, the measures, the verdict and, unless ``with_text`` is off, the cleaned text."""
    src = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text"):
            got = judge(part.column(1).to_pylist(), limits, with_text)
            kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "kept_share": pa.float64(), "clean_text": pa.string()}
            yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(got[c], kinds.get(c, pa.int64())) for c in names], names=["id"] + names)

    out = src.mapInArrow(work, f"id {id_type}, {SCHEMA}")
    return out.withColumnRenamed("id", id_column)


def op5_quality_rules(spark, folder: str) -> DataFrame:
    """Line-first quality verdict of every document."""
    from tamiz.llm.store import table
    return quality(table(spark, folder, "documents"), with_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_lines_removed", F.round("kept_share", 6).alias("kept_share"))
