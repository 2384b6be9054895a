"""Ranked lexical search: the best documents for each query by the Best Position Algorithm over impact lists.

Terms are runs of ASCII letters, digits and non-ASCII bytes; only A-Z are lower-cased. Every row of the documents counts, repeated rows
one by one; a document's score for a query is the sum of integer impacts of the query's terms, repeats included. Results are exact.

1. *Postings.* One pass over the whole texts keeps, for runs of documents, the occurrences of the queries' terms and each document's
   number of terms, packed in rows that stay small beside the text. Words are found by a 64-bit key and confirmed byte by byte.
   The corpus counts (documents, terms, documents of each term) are sums over these rows.
2. *Impact lists.* A task turns each run into lists, one for each term, of ``weight * (1000000000 tf div (1000 tf + 12 m))`` in
   descending order, with a direct access by document.
3. *Best positions.* The lists of a query are read side by side from the top. A document that is met is scored at once by direct
   accesses to all lists, and every access marks the position that it hits. A list's best position is the end of the run of
   marked positions from its top; what lies there bounds every document not yet met, however far down the reading has come, so the sum
   over the lists (the threshold) is tighter than with last-read positions. Reading goes on in growing steps and stops only when the
   threshold is strictly below the k-th best score, so ties are never lost.
4. A task carries each query's best ``k`` from run to run, which lets later runs stop early, often before the first reading. The
   tasks' best are merged by a window.

Queries are rows of one id: their distinct texts together are the query's terms. They are taken in blocks of about ``BLOCK_TERMS``
terms, so what is broadcast is bounded; each block reads the documents once. Null texts have no terms; null ids are kept, a null
document id comes last among equal scores. Only documents with a score above 0 are ranked. Empty tables give no rows. Only the
named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm import words as W
from tamiz.llm.store import stored

#: Postings of one run of documents, terms of one block of queries, first step down the lists.
RUN_POSTINGS, BLOCK_TERMS, STEP = 400_000, 200_000, 32
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Vocabulary:
    """The terms of a block of queries: sorted keys for the search, bytes to confirm."""

    def __init__(self, terms: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in terms]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
        begins = ends - np.array([len(t) for t in raw], np.int64)
        keys = W.span_hashes(data, begins, ends)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.data, self.begins, self.sizes = keys[self.order], data, begins, ends - begins
        #: Terms of equal keys, in all likelihood one.
        self.alike = int(np.unique(keys, return_counts=True)[1].max(initial=0))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word's term, -1 for words that are none."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.keys):
            return out
        keys = W.span_hashes(data, starts, ends)
        first = np.searchsorted(self.keys, keys)
        for k in range(self.alike):
            at = np.minimum(first + k, len(self.keys) - 1)
            term = self.order[at]
            maybe = np.flatnonzero((out < 0) & (self.keys[at] == keys) & (self.sizes[term] == ends - starts))
            if not len(maybe):
                continue
            sizes = self.sizes[term[maybe]]
            edge = np.cumsum(sizes) - sizes
            step = np.arange(sizes.sum()) - np.repeat(edge, sizes)
            same = data[np.repeat(starts[maybe], sizes) + step] == self.data[np.repeat(self.begins[term[maybe]], sizes) + step]
            sure = np.logical_and.reduceat(same, edge)
            out[maybe[sure]] = term[maybe[sure]]
        return out


def postings(docs: DataFrame, vocabulary: Vocabulary, run: int = RUN_POSTINGS) -> DataFrame:
    """Runs of documents: ``ids``, their numbers of terms, and packed postings (document of the run, term, occurrences)."""
    kind = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting = n_docs = 0

        def flush() -> pa.RecordBatch:
            ids = [i for h in held for i in h[0].to_pylist()]
            base = np.cumsum([0] + [len(h[0]) for h in held])
            packed = [np.concatenate([h[2 + k] + (b if k == 0 else 0) for h, b in zip(held, base)]).astype("<u4").tobytes() for k in range(3)]
            n = np.concatenate([h[1] for h in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(held[0][0].type)), pa.array([n], pa.list_(pa.int64())), *[pa.array([p], pa.binary()) for p in packed],
                 pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())],
                names=["ids", "n_terms", "docs", "terms", "times", "n_docs", "total"])

        for piece in W.slices(batches, "text"):
            data, offsets = W.utf8(piece.column(1))
            data = W.ASCII_LOWER[data]
            starts, ends, text_of = W.word_spans(data, offsets, _PARTS)
            found = shared.value.find(data, starts, ends)
            size = max(1, len(shared.value.keys))
            cell, times = np.unique(text_of[found >= 0] * size + found[found >= 0], return_counts=True)
            held.append((piece.column(0), np.bincount(text_of, minlength=piece.num_rows), cell // size, cell % size, times))
            waiting, n_docs = waiting + len(cell), n_docs + piece.num_rows
            if waiting >= run or n_docs >= run:
                yield flush()
                held, waiting, n_docs = [], 0, 0
        if held:
            yield flush()

    return docs.select("id", "text").mapInArrow(work, f"ids array<{kind}>, n_terms array<long>, docs binary, terms binary, times binary, n_docs long, total long")


def document_counts(runs: DataFrame, n_terms: int) -> np.ndarray:
    """Number of documents that hold each term; at most one row a task and term is shuffled, at most one a term collected."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_terms, np.int64)
        for batch in batches:
            for row in batch.column(0):
                sums += np.bincount(np.frombuffer(row.as_py(), "<u4"), minlength=n_terms)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used])], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    if n_terms:
        for r in runs.select("terms").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            out[r["term"]] = r["n"]
    return out


class Lists:
    """The impact lists of one run: postings by term, each list by descending impact, and where each document stands in it."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_docs: int):
        keep = impacts > 0
        docs, terms, impacts = docs[keep], terms[keep], impacts[keep]
        order = np.lexsort((docs, -impacts, terms))
        self.docs, self.impacts, terms = docs[order], impacts[order], terms[order]
        self.terms, self.begins = np.unique(terms, return_index=True)
        self.ends = np.append(self.begins[1:], len(terms))
        self.n_docs = n_docs
        keys = terms * n_docs + self.docs
        self.place = np.argsort(keys)
        self.keys = keys[self.place]

    def access(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Direct access: position of each document (rows) in each term's list (columns), -1 where it is not in it."""
        wanted = terms[None, :] * self.n_docs + docs[:, None]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.place[at], -1)


def best_positions(lists: Lists, terms: np.ndarray, factors: np.ndarray, k: int, floor: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents met and their scores, among them all that can be under the ``k`` best, and the depth read. ``terms`` ascend, each
    counts ``factors`` times. Documents below ``floor`` are of no use: ``k`` better ones are known."""
    at = np.searchsorted(lists.terms, terms)
    there = at < len(lists.terms)
    there[there] = lists.terms[at[there]] == terms[there]
    terms, factors, at = terms[there], factors[there], at[there]
    begins, ends = lists.begins[at], lists.ends[at]
    met = np.zeros(lists.n_docs, bool)
    marked: dict[int, np.ndarray] = {n: np.zeros(e - b + 1, bool) for n, (b, e) in enumerate(zip(begins, ends))}
    best = begins.copy()  # the first position of each list that is not marked
    values = np.append(lists.impacts, 0)
    found, scores, kth, depth = [], [], floor, 0
    while True:
        threshold = int((np.where(best < ends, values[best], 0) * factors).sum())
        if not threshold or threshold < kth:
            break
        read = [lists.docs[min(b + depth, e):min(b + depth + step, e)] for b, e in zip(begins, ends)]
        depth += step
        step *= 2
        new = np.unique(np.concatenate(read))
        new = new[~met[new]]
        met[new] = True
        if len(new):
            hit = lists.access(terms, new)
            found.append(new)
            scores.append((np.where(hit >= 0, values[hit], 0) * factors).sum(axis=1))
            for n, b in enumerate(begins):
                places = hit[:, n]
                marked[n][places[places >= 0] - b] = True
                best[n] = b + int(np.argmin(marked[n]))
            top = np.concatenate(scores)
            if len(top) >= k:
                kth = max(kth, int(np.partition(top, len(top) - k)[len(top) - k]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), depth
    return np.concatenate(found), np.concatenate(scores), depth


def _key(entry: tuple) -> tuple:
    """Order of ``(score, id)``: higher scores first, then smaller ids, a null id last."""
    return -entry[0], entry[1] is None, entry[1] if entry[1] is not None else 0


def ranked(runs: DataFrame, queries: list[tuple], weights: np.ndarray, n_docs: int, total: int, k: int, id_type: str, item_type: str) -> DataFrame:
    """Each task's ``k`` best documents for each query ``(item, terms, factors)``."""
    shared = runs.sparkSession.sparkContext.broadcast((queries, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        best: list[list] = [[] for _ in queries]
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].values
                n = batch.column(1)[row].values.to_numpy()
                docs, terms, times = (np.frombuffer(batch.column(c)[row].as_py(), "<u4").astype(np.int64) for c in (2, 3, 4))
                m = 75 + (25 * n * n_docs) // max(1, total)
                impacts = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 12 * m[docs]))
                lists = Lists(docs, terms, impacts, len(n))
                if not len(lists.docs):
                    continue
                for q, (_, terms_of, factors) in enumerate(queries):
                    floor = best[q][-1][0] if len(best[q]) == k else 0
                    docs_met, scores, _ = best_positions(lists, terms_of, factors, k, floor)
                    if len(scores) > k:
                        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                        docs_met, scores = docs_met[scores >= kth], scores[scores >= kth]
                    fine = scores >= max(floor, 1)
                    if fine.any():
                        mine = zip(scores[fine].tolist(), ids.take(pa.array(docs_met[fine])).to_pylist())
                        best[q] = heapq.nsmallest(k, [*best[q], *mine], key=_key)
        rows = [(q, i, s) for q, found in enumerate(best) for s, i in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([queries[r[0]][0] for r in rows], item_arrow), pa.array([r[1] for r in rows], id_arrow), pa.array([r[2] for r in rows], pa.int64())],
                                             names=["item", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    item_arrow, id_arrow = (f.type for f in to_arrow_schema(StructType.fromDDL(f"a {item_type}, b {id_type}")))
    return runs.select("ids", "n_terms", "docs", "terms", "times").mapInArrow(work, f"item {item_type}, id {id_type}, score long")


def query_terms(items: DataFrame) -> DataFrame:
    """``(item, term, factor)`` of ``(item, text)``."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.where("text IS NOT NULL").distinct().select("item", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    return words.groupBy("item", "term").agg(F.count("*").alias("factor"))


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
           item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item, rank, id, score)``: the ``k`` best documents of every item."""
    src = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    wanted = stored(query_terms(items.select(items[item_column].alias("item"), items[item_text].alias("text"))), "query-terms")
    id_type, item_type = src.schema["id"].dataType.simpleString(), wanted.schema["item"].dataType.simpleString()
    n_blocks = max(1, -(-wanted.count() // block_terms))
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
    parts = []
    for number in range(n_blocks):
        rows = wanted.where(block == number).collect()
        terms = sorted({r["term"] for r in rows})
        place = {t: i for i, t in enumerate(terms)}
        runs = stored(postings(src, Vocabulary(terms)), "postings")
        counted = runs.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
        df = document_counts(runs, len(terms))
        weights = np.floor(1000 * np.log((2 * counted["n"] + 2) / (2 * df + 1))).astype(np.int64)
        by: dict = {}
        for r in rows:
            by.setdefault(r["item"], []).append((place[r["term"]], r["factor"]))
        queries = [(i, *(np.array(x, np.int64) for x in zip(*sorted(found)))) for i, found in by.items()]
        parts.append(ranked(runs, queries, weights, counted["n"], counted["total"], k, id_type, item_type))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")


def op12_lexical_search(spark, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    from tamiz.llm.store import table
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP12_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents WHERE text IS NOT NULL
), docs AS (SELECT r, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0
), corpus AS (SELECT count(*) AS docs_n, CAST(sum(n) AS BIGINT) AS terms_n FROM docs
), asked AS (
    SELECT item_id, term, count(*) AS factor FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)) GROUP BY ALL
), held AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, corpus GROUP BY term, docs_n
), scored AS (
    SELECT item_id, r, doc_id, CAST(sum(factor * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs_n) // terms_n)))) AS BIGINT) AS score
    FROM held JOIN weight USING (term) JOIN asked USING (term), corpus GROUP BY item_id, r, doc_id
), placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""
