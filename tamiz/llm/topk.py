"""Exact top-k search by inner product, in the three phases of a uniform threshold.

A vector's score is the sum over ``blocks`` of its dimensions; each block is a score list of its own. Rows are packed into chunks
of at most ``chunk_rows`` vectors and queries into blocks of as many. Groups of chunks and groups of query blocks of about
``cell_bytes`` each meet in the cells of a grid; a cell is a site of the method and scores one tile of queries and candidates at a time.

1. For each query, each list of each site names its ``k`` largest local scores. The named vectors' whole scores are computed,
   and the ``k``-th largest over all sites is a safe cut-off: at least ``k`` vectors reach it.
2. The cut-offs go back with the queries (one number each). A vector whose whole score reaches the cut-off has, in at least one
   of the ``m`` lists, a local score of ``cut-off / m`` or more, so the entries above that are sufficient.
3. The remaining scores of those entries are resolved exactly, and the best ``k`` of each site, then of all, are the answer.

Components become ``floor(scale * x)``, kept in the narrowest type that holds a chunk; scores are whole numbers. No sum over some
dimensions passes the product of the norms: below 2^24 floats are exact, below 2^53 doubles, and beyond that a chunk is scored in
64-bit integers, which the scores must fit. Vectors that are null or hold a null, NaN or infinity take no part, nor do rows with a
null id. Vectors of different lengths are compared on the dimensions both have. Rows that bear the query's id are its own. Equal
scores go to the smaller id; a repeated candidate row counts once for each row. Fewer than ``k`` candidates give all there are.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.store import stored

CHUNK_ROWS = 4096
CHUNK_BYTES = 8 << 20
CELL_BYTES = 32 << 20
BLOCKS = 4
#: Queries and candidates that are scored at once.
TILE = 256, 1024
#: Below every score.
NONE = np.iinfo(np.int64).min + 1
PACKED = "ids binary, matrix binary, n int, dims int, width int"
TYPES = {2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<f8")}


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``(id, v array<double>)`` of the rows that take part."""
    v = rows[vector_column]
    fine = v.isNotNull() & rows[id_column].isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(fine).select(rows[id_column].cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _pack(ids: np.ndarray, lists: pa.ListArray) -> list[pa.Array]:
    """The columns of ``PACKED`` for one chunk: vectors by id, shorter ones padded with zeros."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    dims = int(sizes.max(initial=0))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    matrix = np.zeros((len(ids), dims))
    matrix[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    most = float(np.abs(flat).max(initial=0))
    width = next((w for w in (2, 4) if most <= np.iinfo(TYPES[w]).max), 8)
    order = np.argsort(ids, kind="stable")
    return [pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), pa.array([matrix[order].astype(TYPES[width]).tobytes()], pa.binary()),
            *(pa.array([x], pa.int32()) for x in (len(ids), dims, width))]


def chunked(vectors: DataFrame, chunk_rows: int) -> DataFrame:
    """``PACKED``: at most ``chunk_rows`` vectors and about ``CHUNK_BYTES`` of doubles in a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest = pc.max(pc.list_value_length(batch.column(1))).as_py() or 1
            step = max(1, min(chunk_rows, CHUNK_BYTES // (8 * longest)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays(_pack(part.column(0).to_numpy(), part.column(1)), names=["ids", "matrix", "n", "dims", "width"])

    return vectors.mapInArrow(work, PACKED)


def _pack_block(table: pa.Table) -> pa.Table:
    lists = pa.concat_arrays(table.column("v").chunks)
    return pa.table([pa.array([table.column("block")[0].as_py()], pa.int32()), *_pack(table.column("id").to_numpy(), lists)], names=["block", "ids", "matrix", "n", "dims", "width"])


def _load(side: pa.Table) -> list[tuple[np.ndarray, np.ndarray, float, int]]:
    """Of each row of ``PACKED``: ids, matrix, greatest norm and place in the table; smallest ids first."""
    out = []
    for at in range(side.num_rows):
        n, dims, width = (side.column(c)[at].as_py() for c in ("n", "dims", "width"))
        matrix = np.frombuffer(side.column("matrix")[at].as_buffer(), TYPES[width]).reshape(n, dims)
        squares = sum((x.astype(np.float64) ** 2 for x in matrix.T), np.zeros(n))
        out.append((np.frombuffer(side.column("ids")[at].as_buffer(), "<i8"), matrix, float(np.sqrt(squares.max(initial=0))), at))
    return sorted(out, key=lambda x: x[0][0])


def _kind(q_norm: float, c_norm: float) -> type:
    """The type in which every sum of products is exact."""
    reach = max(1.0, q_norm) * max(1.0, c_norm) * (1 + 1e-9)
    return np.float32 if reach < 2.0 ** 24 else np.float64 if reach < 2.0 ** 53 else np.int64


def _lists(q: np.ndarray, c: np.ndarray, blocks: int) -> list[np.ndarray]:
    """Local scores of queries (rows) and candidates (columns), one matrix for each list."""
    dims = min(q.shape[1], c.shape[1])
    cuts = np.linspace(0, dims, min(blocks, max(1, dims)) + 1).astype(int)
    return [q[:, a:b] @ c[:, a:b].T for a, b in zip(cuts[:-1], cuts[1:])]


def _tiles(q: np.ndarray, q_norm: float, chunks: list, blocks: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Place among the site's candidates, ids and lists, tile by tile. The first tiles are narrow: all their entries are among the best so far."""
    width, before = 64, 0
    for ids, c, c_norm, _ in chunks:
        kind = _kind(q_norm, c_norm)
        turned, at = q.astype(kind), 0
        while at < len(ids):
            part = c[at:at + width].astype(kind)
            yield before + at, ids[at:at + width], _lists(turned, part, blocks)
            at, width = at + len(part), min(2 * width, TILE[1])
        before += len(ids)


def _entries(open_: np.ndarray, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, column, whole score and flat place of the open entries. Most are closed: eight are looked at together where they can be."""
    flags = open_.ravel()
    if flags.size % 8:
        flat = np.flatnonzero(flags)
    else:
        flat = (8 * np.flatnonzero(flags.view(np.uint64))[:, None] + np.arange(8)).ravel()
        flat = flat[flags[flat]]
    row, col = np.divmod(flat, open_.shape[1])
    return row, col, sum(s.ravel()[flat] for s in lists).astype(np.int64), flat


def _merge(kept: list[np.ndarray], row: np.ndarray, fresh: list[np.ndarray]) -> None:
    """Put new entries into the best of their rows: highest first column, then lowest second."""
    if not len(row):
        return
    touched, k = np.unique(row), kept[0].shape[1]
    rows = np.concatenate([np.repeat(touched, k), row])
    both = [np.concatenate([old[touched].ravel(), new]) for old, new in zip(kept, fresh)]
    order = np.lexsort((both[1], -both[0], rows))
    rows = rows[order]
    take = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
    for old, x in zip(kept, both):
        old[touched] = x[take].reshape(len(touched), k)


def _name(q_ids: np.ndarray, q: np.ndarray, q_norm: float, chunks: list, k: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase one at a site: row and whole score of the best ``k`` entries that a list names among its ``k`` largest."""
    lists_kept: list[list[np.ndarray]] = []
    waiting: list[list[list[np.ndarray]]] = []  # new entries of each list, merged when there are about as many as are kept

    def settle(j: int) -> None:
        row, *fresh = (np.concatenate(x) for x in zip(*waiting[j]))
        _merge(lists_kept[j], row, fresh)
        waiting[j].clear()

    for before, ids, lists in _tiles(q, q_norm, chunks, blocks):
        for j, s in enumerate(lists):
            if j == len(lists_kept):  # local score, place, whole score
                lists_kept.append([np.full((len(q), k), NONE), np.full((len(q), k), -1), np.full((len(q), k), NONE)])
                waiting.append([])
            last = lists_kept[j][0][:, -1]
            row, col, whole, flat = _entries(s >= (last + (last > NONE)).astype(s.dtype)[:, None], lists)
            fine = ids[col] != q_ids[row]
            row, col, whole, flat = row[fine], col[fine], whole[fine], flat[fine]
            waiting[j].append([row, s.ravel()[flat].astype(np.int64), before + col, whole])
            if sum(len(x[0]) for x in waiting[j]) >= len(q) * k:
                settle(j)
    for j in range(len(waiting)):
        if waiting[j]:
            settle(j)
    row = np.concatenate([np.repeat(np.arange(len(q)), k)] * len(lists_kept))
    place, whole = (np.concatenate([kept[x].ravel() for kept in lists_kept]) for x in (1, 2))
    named = np.unique(np.stack([row, place, whole])[:, place >= 0], axis=1)  # an entry that two lists name counts once
    best = [np.full((len(q), k), NONE), np.full((len(q), k), -1)]
    _merge(best, named[0], [named[2], named[1]])
    row, rank = np.nonzero(best[0] > NONE)
    return row, best[0][row, rank]


def _resolve(q_ids: np.ndarray, q: np.ndarray, q_norm: float, chunks: list, k: int, blocks: int, cutoffs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases two and three at a site: row, id and whole score of the best ``k`` that reach the cut-offs, ties to the smaller id."""
    kept = [np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)]
    for _, ids, lists in _tiles(q, q_norm, chunks, blocks):
        # Ids rise within a chunk: an equal score counts only where the k-th best has a larger id than the tile's first.
        last = kept[0][:, -1]
        least = np.maximum(cutoffs, last + ((last > NONE) & (kept[1][:, -1] <= ids[0])))
        local = (-(-least // len(lists))).astype(lists[0].dtype)[:, None]
        open_ = lists[0] >= local
        for s in lists[1:]:
            open_ |= s >= local
        row, col, whole, _ = _entries(open_, lists)
        fine = (whole >= least[row]) & (ids[col] != q_ids[row])
        _merge(kept, row[fine], [whole[fine], ids[col[fine]]])
    row, rank = np.nonzero(kept[0] > NONE)
    return row, kept[1][row, rank], kept[0][row, rank]


def _site(k: int, blocks: int, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The function of a cell, chunks to the left and query blocks to the right: ``(query_id, score)`` of phase one, or the local best."""
    names = ["query_id", "vec_id", "score"] if last else ["query_id", "score"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        chunks, out = _load(left), []
        for q_ids, q, q_norm, at in _load(right) if chunks else []:
            cutoffs = np.frombuffer(right.column("cutoffs")[at].as_buffer(), "<i8") if last else None
            for a in range(0, len(q_ids), TILE[0]):
                b = a + TILE[0]
                row, *found = _resolve(q_ids[a:b], q[a:b], q_norm, chunks, k, blocks, cutoffs[a:b]) if last else _name(q_ids[a:b], q[a:b], q_norm, chunks, k, blocks)
                out.append(pa.table([pa.array(x) for x in (q_ids[a:b][row], *found)], names=names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * len(names), names=names)

    return work


def _top(local: DataFrame, k: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return local.withColumn("rank", rank).where(F.col("rank") <= k)


def _grid(candidates: DataFrame, packed: DataFrame, cell_bytes: int) -> tuple[int, int]:
    """Groups of chunks and of query blocks: about ``cell_bytes`` in each, and some cells for every core where there are chunks enough."""
    (n, size), (_, asked) = (df.agg(F.count("*"), F.coalesce(F.sum(F.col("n").cast("long") * (8 + F.col("dims").cast("long") * F.col("width"))), F.lit(0))).first() for df in (candidates, packed))
    across = max(1, -(-asked // cell_bytes))
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // cell_bytes), min(n, -(-4 * cores // across))), across


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding",
          chunk_rows: int = CHUNK_ROWS, blocks: int = BLOCKS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows for each row that ``is_query`` (a condition on ``id``) marks."""
    vectors = whole_vectors(rows, id_column, vector_column, scale)
    candidates = stored(chunked(vectors, chunk_rows), "topk-chunks")
    queries = vectors.where(is_query).dropDuplicates(["id"])
    # Queries are numbered in blocks by a hash of the id, about chunk_rows each; count and size alone decide how many.
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("long") * 8), F.lit(0))).first()
    n_blocks = max(1, -(-n // chunk_rows), -(-size // CHUNK_BYTES))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    packed = stored(queries.withColumn("block", block).groupBy("block").applyInArrow(_pack_block, f"block int, {PACKED}"), "topk-queries")
    # Every chunk meets every query block: chunks are repeated for each group of blocks, blocks for each group of chunks.
    down, across = _grid(candidates, packed, cell_bytes)

    def meet(asked: DataFrame, last: bool) -> DataFrame:
        left = candidates.withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("cell", F.pmod(F.xxhash64("ids"), F.lit(down)) * across + F.col("across"))
        right = asked.withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("cell", F.col("down").cast("long") * across + F.pmod(F.xxhash64("block"), F.lit(across)))
        left, right = (df.repartition(down * across, "cell").groupBy("cell") for df in (left.drop("across"), right.drop("down")))
        return left.cogroup(right).applyInArrow(_site(k, blocks, last), "query_id long, vec_id long, score long" if last else "query_id long, score long")

    cuts = _top(meet(packed, False), k, F.desc("score")).groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count("*").alias("n")).where(F.col("n") == k)
    with_cuts = stored(_with_cutoffs(packed, cuts), "topk-cutoffs")
    return _top(meet(with_cuts, True), k, F.desc("score"), F.col("vec_id")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _with_cutoffs(packed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Give each query block the cut-offs of its queries, in their order; a query short of ``k`` candidates has none (``NONE``)."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["block"]), pa.int32()), pa.array(ids)], names=["block", "query_id"])

    each = packed.select("block", "ids").mapInArrow(listed, "block int, query_id long").join(cuts, "query_id", "left")
    cutoff = F.coalesce(F.col("cutoff"), F.lit(int(NONE)))
    rows = each.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("query_id", cutoff.alias("c")))).alias("m")).select("block", F.col("m.c").alias("c"))

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(c, "<i8").tobytes() for c in batch.column(1).to_pylist()], pa.binary())], names=["block", "cutoffs"])

    return packed.join(rows.mapInArrow(bytes_of, "block int, cutoffs binary"), "block")


def op8_top_k(spark, folder: str) -> DataFrame:
    """The five best vectors for each query vector (ids divisible by 50)."""
    from tamiz.llm.store import table
    return top_k(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


OP8_SQL = """
WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
