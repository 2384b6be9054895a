"""Best-fit packing by linear grouping.

Documents become token pieces of at most ``capacity`` ids; packing needs only their lengths, and the histogram of lengths has at
most ``capacity`` entries however large the corpus, so the packing is planned on that histogram:

1. lengths over ``capacity / 6`` are large. Sorted, they form groups of equal cardinality, and each length is rounded up to the
   longest of its group;
2. over those few sizes, configurations of a sequence are optimised by column generation (linear programme of whole
   configurations, priced by a knapsack), and whole multiples of each are used;
3. actual documents take every place: the longest that waits and fits the rounded size, and in the last place the longest that
   fits what is left of the sequence;
4. whatever has no place yet, and all small documents, are placed by best fit, longest first, in bulk by equal gaps.

Rounding up can cost sequences where nothing small fills the gaps, so plain best fit of the same histogram is planned as well, and
taken where it saves more than one sequence in 2,000.

The plan says, for ranks of pieces among those of equal length, which sequence and offset they get. It has a few rows for each
length and is broadcast; pieces are ranked within salted parts of their length, so a length that a third of all documents share
is spread over many tasks.

Null text counts as empty (one piece: the closing id). Every row is packed on its own, repeated ones too. An empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm import words as W
from tamiz.llm.store import stored
from tamiz.llm.tokens import stretches

CAPACITY = 2048
END_ID = 0
GROUPS = 160
#: Lengths over this part of the capacity are large.
LARGE = 6
#: Part of the sequences that configurations may cost over the fewest found.
NEAR = 0.0005


def cut_pieces(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of each piece: all full but perhaps the first."""
    pieces = max(1, -(-n_ids // capacity))
    first = n_ids - (pieces - 1) * capacity
    return [(0, first)] + [(first + k * capacity, capacity) for k in range(pieces - 1)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, ids)`` of every document; ``ids`` is null unless wanted."""
    src = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    end = np.array([END_ID], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = stretches(tokenizer_path)
        for part in W.slices(batches, "text"):
            found = [ids + end for ids in encoder.ids([t or "" for t in part.column(1).to_pylist()])]
            cuts = [cut_pieces(len(ids) // 4, capacity) for ids in found]
            owner = np.repeat(np.arange(len(found)), [len(c) for c in cuts])
            number = [k for c in cuts for k in range(len(c))]
            flat = [x for c in cuts for x in c]
            bodies = [found[o][4 * a:4 * (a + n)] for o, (a, n) in zip(owner, flat)]
            ids = pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in bodies], pa.list_(pa.int32())) if with_ids else pa.nulls(len(bodies), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(owner)), pa.array(number, pa.int32()), pa.array([a for a, _ in flat], pa.int64()),
                 pa.array([n for _, n in flat], pa.int64()), pa.array([zlib.crc32(b) for b in bodies], pa.int64()), ids],
                names=["id", "piece", "start", "length", "ids_crc32", "ids"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(work, f"id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>").withColumnRenamed("id", id_column)


def groups_of(lengths: dict[int, int], n_groups: int) -> list[list[tuple[int, int]]]:
    """Runs ``(length, count)``, longest first, cut into groups of equal cardinality; groups that round to one size are joined."""
    runs = sorted(((n, c) for n, c in lengths.items() if c), reverse=True)
    if len(runs) <= n_groups:
        return [[r] for r in runs]
    share = -(-sum(c for _, c in runs) // n_groups)
    out: list[list[tuple[int, int]]] = []
    room = 0
    for n, c in runs:
        while c:
            if not room:
                if not out or out[-1][0][0] != n:
                    out.append([])
                room = share
            take = min(c, room)
            out[-1].append((n, take))
            c, room = c - take, room - take
    return out


def best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits (unbounded knapsack, one vector step for each copy)."""
    best = np.zeros(capacity + 1)
    steps = []
    for g, s in enumerate(sizes):
        if values[g] <= 1e-12:
            continue
        for _ in range(capacity // s):
            better = best[:-s] + values[g]
            taken = better > best[s:] + 1e-12
            if not taken.any():
                break
            best[s:] = np.where(taken, better, best[s:])
            steps.append((g, s, taken))
    out, room = np.zeros(len(sizes)), capacity
    value = best[room]
    for g, s, taken in reversed(steps):
        if room >= s and taken[room - s]:
            out[g] += 1
            room -= s
    return float(value), out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 1500, gap: float = 2e-4) -> list[tuple[tuple[int, ...], int]]:
    """Whole multiples of configurations (counts by size) that stay within demand, from the linear programme."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    x = need / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, column = best_configuration(sizes, prices, capacity)
        if value <= 1 + gap:
            break
        change = np.linalg.solve(basis, column)
        usable = change > 1e-9
        ratio = np.where(usable, np.maximum(x, 0) / np.where(usable, change, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        x = np.linalg.solve(basis, need)
    return [(tuple(int(v) for v in basis[:, j]), int(np.floor(x[j] + 1e-9))) for j in range(k) if x[j] + 1e-9 >= 1]


class Bins:
    """Classes of equal sequences: a count and runs ``(length, copies)``, found by the gap they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_gap: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]

    def add(self, count: int, runs: tuple) -> None:
        if count:
            self.by_gap[self.capacity - sum(n * q for n, q in runs)].append((count, runs))

    def place(self, length: int, count: int) -> None:
        """Best fit of ``count`` equal pieces: always the smallest gap they fit, a new sequence when there is none."""
        gap = length
        while count and gap <= self.capacity:
            if not self.by_gap[gap]:
                gap += 1
                continue
            n, runs = self.by_gap[gap].pop()
            copies = gap // length
            whole = min(n, count // copies)
            self.add(whole, (*runs, (length, copies)))
            count, n = count - whole * copies, n - whole
            if n and count:
                self.add(1, (*runs, (length, count)))
                count, n = 0, n - 1
            self.add(n, runs)
        copies = self.capacity // length
        self.add(count // copies, ((length, copies),))
        self.add(1 if count % copies else 0, ((length, count % copies),))

    def classes(self) -> list[tuple[int, tuple]]:
        return [c for found in self.by_gap for c in found]


class Waiting:
    """Documents not placed yet, by length; finds the longest that fits."""

    def __init__(self, lengths: dict[int, int], capacity: int):
        self.left = [lengths.get(n, 0) for n in range(capacity + 1)]
        self.down = [n if self.left[n] else n - 1 for n in range(capacity + 1)]  # towards the next length that is there

    def longest(self, most: int) -> int:
        """The longest length up to ``most`` that is there, 0 for none."""
        path, n = [], max(0, most)
        while n > 0 and self.down[n] != n:
            path.append(n)
            n = self.down[n]
        for x in path:
            self.down[x] = n
        return max(0, n)

    def take(self, n: int, most: int) -> int:
        took = min(self.left[n], most)
        self.left[n] -= took
        if not self.left[n]:
            self.down[n] = n - 1
        return took


def fill(waiting: Waiting, places: list[int], copies: int, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)``: actual documents for ``copies`` sequences of a configuration. Each place takes the longest document
    that waits and fits it; the last place has all that is left of the sequence."""
    classes: list[tuple[int, tuple[int, ...]]] = [(copies, ())]
    for k, size in enumerate(places):
        after = []
        for count, held in classes:
            room = capacity - sum(held)
            most = room if k == len(places) - 1 else min(size, room)
            while count and (n := waiting.longest(most)):
                took = waiting.take(n, count)
                after.append((took, (*held, n)))
                count -= took
            if count:
                after.append((count, held))
        classes = after
    return [(count, held) for count, held in classes if held]


def configured(lengths: dict[int, int], capacity: int, chosen: list[tuple[list[int], int]], worst: int) -> tuple[Bins, int]:
    """Sequences by configurations ``(sizes, copies)`` of large documents, the rest by best fit; and how many large documents a
    configuration has put together with others. A filled configuration stands if its gap is none, or over ``worst``, so that small
    documents can fill it; others are given up to best fit."""
    bins, together = Bins(capacity), 0
    waiting = Waiting({n: c for n, c in lengths.items() if n > capacity // LARGE}, capacity)
    rest = {n: c for n, c in lengths.items() if n <= capacity // LARGE}
    for places, copies in chosen:
        for count, held in fill(waiting, places, copies, capacity):
            if 0 < capacity - sum(held) <= worst or len(held) == 1:
                for n in held:
                    rest[n] = rest.get(n, 0) + count
            else:
                bins.add(count, tuple((n, held.count(n)) for n in dict.fromkeys(held)))
                together += count * len(held)
    for n, c in enumerate(waiting.left):
        if c:
            rest[n] = rest.get(n, 0) + c
    for n in sorted(rest, reverse=True):
        bins.place(n, rest[n])
    return bins, together


def templates(lengths: dict[int, int], capacity: int, n_groups: int) -> list[tuple[list[int], int]]:
    """Configurations of the large documents' rounded lengths, the fullest first: sizes, longest first, and copies."""
    groups = groups_of({n: c for n, c in lengths.items() if n > capacity // LARGE}, n_groups)
    sizes, demand = [g[0][0] for g in groups], [sum(c for _, c in g) for g in groups]
    found = configurations(sizes, demand, capacity) if groups else []
    return sorted((([s for s, a in zip(sizes, config) for _ in range(a)], copies) for config, copies in found), key=lambda c: (-sum(c[0]), c))


def best_fit(lengths: dict[int, int], capacity: int) -> Bins:
    bins = Bins(capacity)
    for n in sorted(lengths, reverse=True):
        bins.place(n, lengths[n])
    return bins


def best_plan(lengths: dict[int, int], capacity: int, n_groups: int, near: float = NEAR) -> tuple[Bins, int, int]:
    """The sequences, how many large documents a configuration has put together with others, and how many sequences plain best fit
    of all documents takes.

    Tried are all configurations or three in four copies of each, taken as they come or only without a gap that small documents can
    hardly fill (up to the middle of their lengths), and plain best fit. Of those that need at most ``near`` times more sequences than the
    fewest, the one that puts most large documents together by configurations is taken."""
    def size(bins: Bins) -> int:
        return sum(c for c, _ in bins.classes())

    plain = best_fit(lengths, capacity)
    small = sorted((n, c) for n, c in lengths.items() if n <= capacity // LARGE)
    half = np.cumsum([c for _, c in small])
    middle = small[int(np.searchsorted(half, half[-1] / 2))][0] if small else 0
    chosen = templates(lengths, capacity, n_groups)
    tried = [(plain, 0)] + [configured(lengths, capacity, [(places, copies * share // 4) for places, copies in chosen if copies * share // 4], worst)
                            for share in (4, 3) for worst in dict.fromkeys((0, middle))]
    fewest = min(size(bins) for bins, _ in tried)
    bins, together = max((t for t in tried if size(t[0]) <= (1 + near) * fewest), key=lambda t: (t[1], -size(t[0])))
    return bins, together, size(plain)


def plan(lengths: dict[int, int], capacity: int = CAPACITY, n_groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, rank_from, rank_to, sequence_from, copies, offset)``: the piece of rank ``r`` among those of its length,
    ``rank_from <= r < rank_to``, is number ``i = r - rank_from``: sequence ``sequence_from + i div copies``, at
    ``offset + (i mod copies) * length``."""
    bins = best_plan(lengths, capacity, n_groups)[0]
    rows, ranks, sequence = [], dict.fromkeys(lengths, 0), 0
    for count, runs in bins.classes():
        at = 0
        for n, copies in runs:
            rows.append((n, ranks[n], ranks[n] + count * copies, sequence, copies, at))
            ranks[n] += count * copies
            at += n * copies
        sequence += count
    return rows


def pack(found: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", n_groups: int = GROUPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (``id, piece, length, ...``)."""
    spark = found.sparkSession
    hist = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    total = sum(hist.values())
    rows = plan(hist, capacity, n_groups)
    places = spark.createDataFrame(rows, "length long, rank_from long, rank_to long, sequence_from long, copies long, offset_from long")
    # Parts of a length for ranking: small enough to spread the commonest one, large enough to keep the list of parts short.
    part_rows = max(64, min(20_000, total // 4000))
    parts = spark.createDataFrame([(n, -(-c // part_rows)) for n, c in hist.items()], "length long, parts long")
    salted = found.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64(id_column, "piece"), F.col("parts"))).drop("parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (salted.groupBy("length", "part").agg(F.count("*").alias("n"))
             .select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("length", "part").orderBy(id_column, "piece", "start")
    ranked = (salted.withColumn("rank", F.row_number().over(inside) - 1).join(bases, ["length", "part"])
              .withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part"))
    number = F.col("rank") - F.col("rank_from")
    return (ranked.join(F.broadcast(places), "length").where("rank >= rank_from AND rank < rank_to")
            .withColumn("sequence_id", F.col("sequence_from") + F.floor(number / F.col("copies")))
            .withColumn("offset", F.col("offset_from") + F.pmod(number, F.col("copies")) * F.col("length"))
            .drop("rank", "rank_from", "rank_to", "sequence_from", "copies", "offset_from"))


def sequences(packed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Packed token sequences ``(sequence_id, ids, members)`` from packed pieces with ids; at most ``capacity`` ids each."""
    member = F.struct("offset", F.col(id_column).alias("id"), "piece", "length", "ids")
    ordered = F.array_sort(F.collect_list(member))
    return (packed.groupBy("sequence_id").agg(ordered.alias("m"))
            .select("sequence_id", F.flatten(F.col("m.ids")).alias("ids"),
                    F.transform("m", lambda m: F.struct(m["id"].alias("id"), m["piece"].alias("piece"), m["offset"].alias("offset"), m["length"].alias("length"))).alias("members")))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    found = pieces(docs, tokenizer_path, capacity, id_column, text_column, with_ids)
    return pack(stored(found if with_ids else found.drop("ids"), "pieces"), capacity, id_column)


def op1_best_fit_packing(spark, folder: str) -> DataFrame:
    """Place of every piece of every document in sequences of at most 2048 tokens."""
    import public_tokenizers

    from tamiz.llm.store import table
    packed = pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
