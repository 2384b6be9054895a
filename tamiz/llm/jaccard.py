"""N-gram Jaccard join over a token-group matrix: exact classes of documents whose word shingles overlap enough.

Sets: distinct 64-bit keys of 5-word shingles (ASCII lower case); with fewer words the whole sequence is the one shingle; without
words the set is empty and links with nothing. Documents link when ``100 * |A & B| >= 75 * |A | B|``.

1. Frequencies. Tasks count shingles by a 32-bit print, so prints common to ``common`` or more documents are known (the
   ``most_common`` commonest of them). Equal sets become one node, so copies cost nothing from here on.
2. Candidates. Linked sets share one of their first ``n - ceil(3n/4) + 1`` shingles in any order that is the same for all; ours
   puts common ones last. Those heads are sent to token ranges as packed arrays, and only shingles of two or more documents come
   back as rows. Common shingles are known to be shared, so they bypass the ranges and are spread by document.
3. Groups. For each shared shingle the smallest node is a centre. A centre and a node that share enough head shingles, counted
   where that node is the centre, are compared exactly; their links join similar documents into groups. This leaves few links
   open, however large a set of near copies is.
4. The matrix. Nodes without a link so far are grouped by their commonest open shingle and by length. All groups are cut into blocks
   of about ``BLOCK_NODES``; the matrix holds each block's union of head shingles. A node is a query for the blocks of other groups,
   and within a group that no links made for its own blocks too. Its overlap with a block's union bounds the head shingles that it shares with
   any member, and what lies behind the heads is bounded by their ends, so only blocks whose overlap reaches the difference
   qualify. Of those, the union of the whole sets must hold ``ceil(3n/4)`` of the query; only then members are compared.
5. Links between groups give the components; every document takes the component of its node.

Every link between different sets is either inside a linked group or found in step 4, so the classes are exact. Overlaps are computed on
64-bit keys; only a collision within two compared sets could change one. Null text counts as empty. Repeated ids are told apart
by nothing, so ids should be unique; a repeated row is a copy of itself. A row without an id has no set that could be looked up: it gets
``n_shingles`` 0 whatever its text, as in the SQL. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm import words as W
from tamiz.llm.components import components
from tamiz.llm.store import bounded_batches, stored

SHINGLE = 5
COMMON = 4
MOST_COMMON = 2_000_000
#: Packed entries a task gathers before it sends them on, and entries of one range at its receiver.
FLUSH = 1 << 18
RANGE_ENTRIES = 250_000
BLOCK_NODES = 64
MEMBERS = 256
#: Ids that may be broadcast to pick texts out of a scan; more are joined by a shuffle.
MOST_BROADCAST = 500_000

_OWN = 0x243F6A8885A308D3


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one text after another, and the ``n + 1`` bounds."""
    data, offsets = W.utf8(column)
    starts, ends, text_of = W.word_spans(data, offsets)
    n = len(column)
    keys = W.span_hashes(W.ASCII_LOWER[data], starts, ends)
    grams = W.combine(keys, SHINGLE)
    whole = text_of[:len(grams)] == text_of[SHINGLE - 1:] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[whole], text_of[:len(whole)][whole]
    counts = np.bincount(text_of, minlength=n)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        begin = np.cumsum(counts) - counts
        extra = [W.combine(np.append(keys[begin[t]:begin[t] + counts[t]], np.uint64(_OWN + int(counts[t]))), int(counts[t]) + 1)[0] for t in short]
        grams, owner = np.append(grams, np.array(extra, np.uint64)), np.append(owner, short)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(n + 1))


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, which the shuffle's compression shortens well."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if len(values) else b""


def unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel() if raw else np.zeros(0, kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack(raw, kind), dtype=kind)


def least_common(n: np.ndarray | int):
    """Smallest overlap with any set that a set of ``n`` links to."""
    return (3 * n + 3) // 4


def linked(common, n, m):
    return 100 * common >= 75 * (n + m - common)


def _ranges(tokens: np.ndarray, n_ranges: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)


def survey(src: DataFrame, n_ranges: int, common: int) -> DataFrame:
    """Rows ``(print, df)`` of common prints and ``(doc, n, key1, key2)`` of every document with words, from one pass."""
    def emit(prints: list, docs: list) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(prints), return_counts=True) if prints else (np.zeros(0, np.uint32), np.zeros(0, int))
        bounds = np.searchsorted(found, (np.arange(n_ranges + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(n_ranges))
        rows = np.concatenate(docs) if docs else np.zeros((0, 4), np.int64)
        part = rows[:, 0] % n_ranges
        out = []
        for r in range(n_ranges):
            a, b = bounds[r], bounds[r + 1]
            mine = rows[part == r]
            if b > a or len(mine):
                out.append((r, pack_sorted(found[a:b]), pack(np.minimum(counts[a:b], 65535).astype(np.uint16)), mine.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                                          names=["range", "prints", "counts", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, docs, held = [], [], 0
        for piece in W.slices(batches, "text"):
            grams, bounds = shingle_sets(piece.column(1))
            ids = piece.column(0).to_numpy(zero_copy_only=False)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            prints.append((grams >> np.uint64(32)).astype(np.uint32))
            if len(full):
                sums = [np.add.reduceat(W.mix(grams ^ np.uint64(seed)), bounds[:-1][full]).view(np.int64) for seed in (1, _OWN)]
                docs.append(np.column_stack([ids[full], n[full], *sums]))
            held += len(grams)
            if held >= 2 * FLUSH:
                yield emit(prints, docs)
                prints, docs, held = [], [], 0
        yield emit(prints, docs)
        W.release()

    def gather(table: pa.Table) -> pa.Table:
        W.release()
        prints = np.concatenate([unpack_sorted(x.as_py(), np.uint32) for x in table.column("prints")])
        counts = np.concatenate([unpack(x.as_py(), np.uint16) for x in table.column("counts")]).astype(np.int64)
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        new = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, int)
        df = np.add.reduceat(counts, new) if len(new) else np.zeros(0, np.int64)
        hot = df >= common
        rows = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, 4) for x in table.column("docs")])
        size = int(hot.sum())
        nothing = lambda k: pa.nulls(k, pa.int64())
        return pa.table([pa.concat_arrays([pa.array(prints[new][hot].astype(np.int64)), nothing(len(rows))]), pa.concat_arrays([pa.array(df[hot]), nothing(len(rows))]),
                         *[pa.concat_arrays([nothing(size), pa.array(np.ascontiguousarray(rows[:, k]))]) for k in range(4)]], names=["print", "df", "doc", "n", "key1", "key2"])

    sent = src.mapInArrow(count, "range int, prints binary, counts binary, docs binary")
    return sent.groupBy("range").applyInArrow(gather, "print long, df long, doc long, n long, key1 long, key2 long")


def common_prints(seen: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted common prints and their class (log2 of their documents): the commonest classes, as many as hold at most ``most`` together."""
    hot = seen.where("df IS NOT NULL").withColumn("class", F.floor(F.log2("df")).cast("int"))
    sizes = {r["class"]: r["count"] for r in hot.groupBy("class").count().collect()}
    least, room = max(sizes, default=0) + 1, most
    # Classes may have gaps, as one large group of copies leaves above all others.
    for k in sorted(sizes, reverse=True):
        if sizes[k] > room:
            break
        least, room = k, room - sizes[k]
    rows = hot.where(F.col("class") >= least).select("print", "class").toArrow()
    prints = rows.column("print").to_numpy().astype(np.uint32)
    order = np.argsort(prints)
    return prints[order], rows.column("class").to_numpy().astype(np.int8)[order]


def heads(src: DataFrame, prints: np.ndarray, classes: np.ndarray, n_ranges: int) -> DataFrame:
    """``(token, doc)`` of every head shingle that two or more documents share, and ``(doc, last)`` of every document with words:
    where its head ends in the common order (class, then the first 56 bits of the shingle)."""
    shared = src.sparkSession.sparkContext.broadcast((prints, classes))

    def emit(tokens: list, docs: list, known: list) -> pa.RecordBatch:
        """``known``: 0 for a shingle that must be looked up, 1 for one known to be shared, 2 for the end of a head."""
        t, d, k = np.concatenate(tokens), np.concatenate(docs), np.concatenate(known)
        goes = np.where(k, d.astype(np.uint64) % np.uint64(n_ranges), _ranges(t, n_ranges))
        order = np.lexsort((t, k, goes))
        t, d, k, goes = t[order], d[order], k[order], goes[order]
        cuts = np.flatnonzero(np.append(True, (goes[1:] != goes[:-1]) | (k[1:] != k[:-1]))) if len(t) else np.zeros(0, int)
        ends = np.append(cuts[1:], len(t))
        return pa.RecordBatch.from_arrays([pa.array(goes[cuts].astype(np.int32)), pa.array(k[cuts]), pa.array([pack_sorted(t[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
                                           pa.array([pack(d[a:b]) for a, b in zip(cuts, ends)], pa.binary())], names=["range", "known", "tokens", "docs"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, classes = shared.value
        tokens, docs, known, held = [], [], [], 0
        for piece in W.slices(batches, "text"):
            grams, bounds = shingle_sets(piece.column(1))
            if not len(grams):
                continue
            n = np.diff(bounds)
            owner = np.repeat(np.arange(len(n)), n)
            cls = np.zeros(len(grams), np.int8)
            if len(prints):
                p = (grams >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(prints, p), len(prints) - 1)
                cls = np.where(prints[at] == p, classes[at], 0)
            order = np.lexsort((grams, cls, owner))
            rank = np.arange(len(grams)) - np.repeat(bounds[:-1], n)
            take = order[rank < np.repeat(n - least_common(n) + 1, n)]
            tokens.append(grams[take])
            docs.append(piece.column(0).to_numpy(zero_copy_only=False)[owner[take]])
            known.append((cls[take] > 0).astype(np.int8))
            full = np.flatnonzero(n)
            ends = order[bounds[:-1][full] + n[full] - least_common(n[full])]
            tokens.append((cls[ends].astype(np.uint64) << np.uint64(56)) | (grams[ends] >> np.uint64(8)))
            docs.append(piece.column(0).to_numpy(zero_copy_only=False)[full])
            known.append(np.full(len(full), 2, np.int8))
            held += len(take) + len(full)
            if held >= FLUSH:
                yield emit(tokens, docs, known)
                tokens, docs, known, held = [], [], [], 0
        if tokens:
            yield emit(tokens, docs, known)
        W.release()

    def gather(table: pa.Table) -> pa.Table:
        W.release()
        known = table.column("known").to_numpy()
        t = [unpack_sorted(x.as_py(), np.uint64) for x in table.column("tokens")]
        d = [unpack(x.as_py(), np.int64) for x in table.column("docs")]
        none = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        tokens, docs = (np.concatenate([x for x, k in zip(of, known) if k == 0] or no) for of, no in zip((t, d), none))
        order = np.argsort(tokens, kind="stable")
        tokens, docs = tokens[order], docs[order]
        same = tokens[1:] == tokens[:-1]
        both = np.append(same, False) | np.append(False, same) if len(tokens) else np.zeros(0, bool)
        out_t = np.concatenate([tokens[both], *[x for x, k in zip(t, known) if k == 1]]).view(np.int64)
        last, last_d = (np.concatenate([x for x, k in zip(of, known) if k == 2] or no) for of, no in zip((t, d), none))
        out_d = np.concatenate([docs[both], *[x for x, k in zip(d, known) if k == 1], last_d])
        return pa.table({"token": pa.concat_arrays([pa.array(out_t), pa.nulls(len(last), pa.int64())]), "doc": out_d,
                         "last": pa.concat_arrays([pa.nulls(len(out_t), pa.int64()), pa.array(last.view(np.int64))])})

    return src.mapInArrow(cut, "range int, known byte, tokens binary, docs binary").groupBy("range").applyInArrow(gather, "token long, doc long, last long")


def sets_of(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, set binary)`` of the wanted nodes: their whole sets, computed from their texts again."""
    few = wanted.count() <= MOST_BROADCAST
    picked = src.join(F.broadcast(wanted) if few else wanted, src["id"] == wanted["node"], "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.slices(batches, "text"):
            grams, bounds = shingle_sets(piece.column(1))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([pack_sorted(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["node", "set"])
        W.release()

    return picked.mapInArrow(work, "node long, set binary")


def _overlap(sets: list[np.ndarray], whole: np.ndarray) -> np.ndarray:
    """Size of each set's intersection with a sorted set."""
    if not len(whole) or not sets:
        return np.zeros(len(sets), np.int64)
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(whole, flat), len(whole) - 1)
    return np.add.reduceat((whole[at] == flat).astype(np.int64), np.cumsum([0] + [len(s) for s in sets[:-1]]))


def star_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` ``(a, b)`` that link, as ``(a, b)``. A centre's members are compared in parts of about ``MEMBERS``."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    members = (pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
               .join(sets, F.col("b") == F.col("node")).select("a", "part", F.col("b").alias("node"), "set"))
    centres = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(sets, F.col("a") == F.col("node")).select("a", "part", "node", "set")

    def compare(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        a = table.column("a")[0].as_py()
        sets = [unpack_sorted(x.as_py(), np.uint64) for x in table.column("set")]
        centre = [s for s, n in zip(sets, nodes) if n == a][0]
        rest = [k for k, n in enumerate(nodes) if n != a]
        common = _overlap([sets[k] for k in rest], centre)
        sizes = np.array([len(sets[k]) for k in rest], np.int64)
        hit = nodes[rest][linked(common, len(centre), sizes)] if rest else np.zeros(0, np.int64)
        return pa.table({"a": np.full(len(hit), a), "b": hit.astype(np.int64)})

    return members.unionByName(centres).groupBy("a", "part").applyInArrow(compare, "a long, b long")


def block_links(asked: DataFrame, blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of queries ``(block, node)`` with members ``(block, node, loose)`` of the blocks they ask: one for each query
    and block of a linked group at most, since its members are in one component already, and all of a loose block's."""
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    queries = (asked.join(parts, "block").select("block", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), F.lit(True).alias("asks"), F.lit(False).alias("loose"), F.col("node").alias("q"))
               .join(sets, F.col("q") == F.col("node")).select("block", "part", "asks", "loose", "node", "set"))
    members = (parts.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
               .join(blocks.select("block", "loose", F.col("node").alias("q")), "block")
               .join(sets, F.col("q") == F.col("node")).select("block", "part", F.lit(False).alias("asks"), "loose", "node", "set"))

    def open_block(table: pa.Table) -> pa.Table:
        asks, nodes = table.column("asks").to_numpy(), table.column("node").to_numpy()
        loose = table.column("loose").to_numpy()
        sets = [unpack_sorted(x.as_py(), np.uint64) for x in table.column("set")]
        lengths = np.array([len(s) for s in sets], np.int64)
        inside, outside = np.flatnonzero(~asks), np.flatnonzero(asks)
        union = np.unique(np.concatenate([sets[k] for k in inside]))
        bound = _overlap([sets[k] for k in outside], union)
        a, b = [], []
        for k, most in zip(outside, bound):
            n = len(sets[k])
            if most < least_common(n):
                continue
            # A query that is a member itself meets those before it.
            inner = (nodes[inside] == nodes[k]).any()
            fits = inside[(4 * np.minimum(lengths[inside], n) >= 3 * np.maximum(lengths[inside], n)) & ((nodes[inside] < nodes[k]) | (not inner))]
            hits = fits[linked(_overlap([sets[j] for j in fits], sets[k]), n, lengths[fits])] if len(fits) else fits
            if len(hits) and not loose[hits[0]]:
                hits = hits[:1]
            a += [nodes[k]] * len(hits)
            b += nodes[hits].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return queries.unionByName(members).groupBy("block", "part").applyInArrow(open_block, "a long, b long")


def _tail(n: str) -> Column:
    """Shingles of a set after its head."""
    return F.floor((3 * F.col(n) + 3) / 4) - 1


def _least_shared(n: str, m: str, tail: Column) -> Column:
    """Head shingles that linked sets of ``n`` and ``m`` share at least, when at most ``tail`` of their overlap is not in both heads."""
    return F.greatest(F.lit(1), F.floor((3 * (F.col(n) + F.col(m)) + 6) / 7) - tail)


def jaccard_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` of every document; the component is the smallest id that links reach."""
    bounded_batches(docs.sparkSession)
    src = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text"))
    has_id = src.where("id IS NOT NULL")
    seen = stored(survey(has_id, max(8, 4 * has_id.rdd.getNumPartitions()), COMMON), "shingle-survey")
    info = seen.where("doc IS NOT NULL").select("doc", "n", "key1", "key2").distinct()
    entries = info.agg(F.sum(F.col("n") / 4 + 1)).first()[0] or 0
    node_of = stored(info.join(info.groupBy("n", "key1", "key2").agg(F.min("doc").alias("node")), ["n", "key1", "key2"]).select("doc", "node", "n"), "shingle-nodes")
    prints, classes = common_prints(seen, MOST_COMMON)
    found = stored(heads(has_id, prints, classes, max(1, -(-int(entries) // RANGE_ENTRIES))), "shingle-heads")
    ends = found.where("last IS NOT NULL").select("doc", "last").distinct()
    posted = found.where("token IS NOT NULL").select("token", "doc").join(node_of, "doc").select("token", "node", "n").distinct()
    # Shingles of one node only (of copies) tie it to nothing. The order of heads decides which overlaps their tails allow.
    span = posted.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("token", "a")
    shared = stored(posted.join(span, "token").join(ends.withColumnRenamed("doc", "node"), "node").select("token", "a", "node", "n", "last"), "shingle-shared")
    facts = shared.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("last").alias("z")).distinct()
    counted = shared.where("node <> a").groupBy("a", F.col("node").alias("b"), "n", "last").agg(F.count("*").alias("c")).join(facts, "a")
    tail = F.when(F.col("last") < F.col("z"), _tail("n")).when(F.col("last") > F.col("z"), _tail("m")).otherwise(F.greatest(_tail("n"), _tail("m")))
    pairs = stored(counted.where((4 * F.least("n", "m") >= 3 * F.greatest("n", "m")) & (F.col("c") >= _least_shared("n", "m", tail))).select("a", "b"), "shingle-pairs")
    near = star_links(pairs, sets_of(has_id, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    groups = components(near)
    grouped = shared.join(groups, "node", "left").select("token", "node", "n", "last", F.coalesce("component", "node").alias("component"), F.isnull("component").alias("loose"))
    apart = grouped.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    open_ = stored(grouped.join(apart, "token"), "shingle-open")
    # Nodes without a link so far form groups by their commonest open shingle and by length, so neighbours that a shared passage makes
    # meet as blocks and not one by one.
    met_by = open_.groupBy("token").agg(F.count("*").alias("df"))
    leading = open_.where("loose").join(met_by, "token").groupBy("node").agg(F.max(F.struct("df", "token"))["token"].alias("leading"))
    group = F.when(F.col("loose"), F.xxhash64("leading", F.floor(F.log(F.col("n")) / math.log(4 / 3)))).otherwise(F.col("component"))
    nodes = open_.select("node", "n", "last", "component", "loose").distinct().join(leading, "node", "left").select("node", "n", "last", "loose", group.alias("group"))
    # A group is cut into blocks in the order of lengths, which only the counts of each length are sorted for; a length with more nodes
    # than a block holds is split by hash.
    shorter = Window.partitionBy("loose", "group").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    lengths = nodes.groupBy("loose", "group", "n").agg(F.count("*").alias("nodes")).select(
        "loose", "group", "n", F.floor(F.coalesce(F.sum("nodes").over(shorter), F.lit(0)) / BLOCK_NODES).alias("k"), F.ceil(F.col("nodes") / BLOCK_NODES).alias("parts"))
    part = F.when(F.col("parts") > 1, F.struct("n", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")))
    blocks = stored(nodes.join(lengths, ["loose", "group", "n"]).select("node", "n", "last", "loose", "group", F.xxhash64("loose", "group", "k", part).alias("block")), "shingle-blocks")
    bounds = blocks.groupBy("block").agg(F.count("*").alias("nodes"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.min("last").alias("first_end"), F.max("last").alias("last_end"))
    entries = open_.select("token", "node").join(blocks.select("node", "loose", "group", "block"), "node")
    matrix = entries.select("token", F.col("loose").alias("of_loose"), F.col("group").alias("of_group"), F.col("block").alias("asked")).distinct()
    # Of two blocks one asks the other. Members of a linked group need not ask it; those of a loose one ask their own block too.
    asks = (F.col("block") > F.col("asked")) & ~(~F.col("loose") & ~F.col("of_loose") & (F.col("group") == F.col("of_group"))) | F.col("loose") & (F.col("block") == F.col("asked"))
    met = entries.join(matrix, "token").where(asks).groupBy("node", "asked").agg(F.count("*").alias("c"))
    rest = (F.when(F.col("last") < F.col("first_end"), _tail("n")).when(F.col("last") > F.col("last_end"), _tail("longest"))
            .otherwise(F.greatest(_tail("n"), _tail("longest"))))
    qualifies = (4 * F.col("longest") >= 3 * F.col("n")) & (4 * F.col("n") >= 3 * F.col("shortest")) & (F.col("c") >= _least_shared("n", "shortest", rest))
    asked = (met.join(blocks.select("node", "n", "last", F.col("block").alias("own")), "node").join(bounds.withColumnRenamed("block", "asked"), "asked")
             .where(qualifies & ((F.col("own") != F.col("asked")) | (F.col("nodes") > 1))))
    asked = stored(asked.select("node", F.col("asked").alias("block")), "shingle-asked")
    used = asked.select("node").union(blocks.join(asked.select("block").distinct(), "block", "left_semi").select("node")).distinct()
    across = block_links(asked, blocks, sets_of(has_id, used))
    joined = across.join(groups.select(F.col("node").alias("b"), F.col("component").alias("g")), "b", "left").select("a", F.coalesce("g", "b").alias("b"))
    joined = joined.join(groups.select(F.col("node").alias("a"), F.col("component").alias("g")), "a", "left").select(F.coalesce("g", "a").alias("a"), "b")
    top = components(joined).select(F.col("node").alias("g"), F.col("component").alias("top"))
    of_node = (node_of.join(groups, "node", "left").withColumn("g", F.coalesce("component", "node")).join(top, "g", "left")
               .select(F.col("doc").alias("id"), "n", F.coalesce("top", "g").alias("component")))
    return (src.select("id").join(of_node, "id", "left")
            .select(F.col("id").alias(id_column), F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component", "id").alias("component_id")))


def one_of_each_class(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class. Rows that share an id stay or go together; rows without an id
    stay."""
    classes = stored(jaccard_classes(docs, id_column, text_column), "shingle-classes")
    gone = classes.where(F.col(id_column) != F.col("component_id")).select(F.col(id_column).cast("long").alias("__gone")).distinct()
    few = gone.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, docs[id_column].cast("long") == gone["__gone"], "left_anti")


def op7_jaccard_join(spark, folder: str) -> DataFrame:
    """Set size and class of every document."""
    from tamiz.llm.store import table
    return jaccard_classes(table(spark, folder, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ') || ' /' || len(ws)]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
s AS (SELECT DISTINCT doc_id, shingle FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
