"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Size of a document: its words. Targets: weights share ``budget`` times all words; no source gets more than ``most_repeats`` times
its words, the excess is shared again by weight (closed form: the target is ``min(cap, level * weight)``, and the level follows
from the sources in the order of ``cap / weight``).

Document rates: of all rates in ``[0, most_repeats]`` that meet the token constraint of each source, those nearest to 1 by
relative entropy. The convex dual has one multiplier for each source, and tilts a document's rate exponentially in its size,
``rate = min(most_repeats, exp(multiplier * size / mean size))``. Each Newton iteration is one aggregation over the histogram of
(source, size), kept inside a bracket by bisection; multipliers stay in a table, nothing is collected but one number that says
whether to go on. Terms are summed as decimals, so reruns agree to the last digit.

Rates become copies by systematic rounding along the sizes of a source: cumulative expected copies are rounded, each size gets
the difference, salted parts of a size share it the same way, and inside a part the first documents by a hash get one more. What
a source is then off its target, about one document, is settled on the histogram by single documents of fitting sizes.

Null text has size 0, a null source is a source of its own, after all others. A source without words has target 0 and takes
nothing; its documents keep one copy (they cost no words). Repeated rows are mixed one by one. Empty tables give empty results.
Only the named columns are read, others of :func:`mixed_documents` pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.store import stored

ROUNDS = 60
PART_ROWS = 1024
SETTLE_ROUNDS = 6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: Sequence[float], budget: float, most_repeats: float) -> DataFrame:
    """Add ``weight`` and ``target`` to ``(source, source_size)``, one row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sources.withColumn("weight", weight).withColumn("cap", F.lit(float(most_repeats)) * F.col("source_size"))
    in_order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far = in_order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # The level if all sources before this one are at their caps; right for the first that stays below its own.
    level = (F.lit(float(budget)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(so_far), F.lit(0.0))) / F.sum("weight").over(onwards)
    return (capped.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
            .withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
            .select("source", "source_size", "weight", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target")))


def _rate(most_repeats: float) -> Column:
    """The tilted rate from ``multiplier``, ``size`` and ``mean_size``."""
    exponent = F.col("multiplier") * F.col("size") / F.col("mean_size")
    return (F.when(F.col("mean_size").isNull() | (F.col("size") == 0), 1.0).when(F.col("multiplier").isNull(), float(most_repeats))
            .otherwise(F.least(F.lit(float(most_repeats)), F.exp(F.least(exponent, F.lit(50.0))))))


def balance(hist: DataFrame, goals: DataFrame, most_repeats: float, rounds: int = ROUNDS, tolerance: float = 1e-7) -> DataFrame:
    """Add ``multiplier`` and ``mean_size`` to the goals. The multiplier is null where every document is taken to the limit.

    ``hist``: ``(source, size, n)``; ``goals``: ``(source, source_size, target)``."""
    top = float(most_repeats)
    mean = hist.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size"))
    state = (goals.join(mean, goals["source"].eqNullSafe(mean["source"]), "left").drop(mean["source"])
             .withColumn("full", F.col("target") >= F.lit(top) * F.col("source_size") * (1 - 1e-12))
             .withColumn("multiplier", F.when(F.col("full") | F.col("mean_size").isNull(), F.lit(None)).otherwise(F.lit(0.0)).cast("double"))
             .withColumn("low", F.lit(-1e7)).withColumn("high", F.lit(1e7)).withColumn("error", F.lit(1.0)))
    state = stored(state, "mix-state")
    for _ in range(rounds):
        at = state.where("multiplier IS NOT NULL").select(F.col("source").alias("s"), "multiplier", "mean_size")
        rate = _rate(top)
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < top, words * F.col("size") / F.col("mean_size")).otherwise(0.0)
        sums = (hist.join(at, hist["source"].eqNullSafe(at["s"]))
                .groupBy("s").agg(F.sum(words.cast("decimal(34,6)")).cast("double").alias("words"), F.sum(slope.cast("decimal(34,6)")).cast("double").alias("slope")))
        moved = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left")
        over = F.col("words") - F.col("target")
        low = F.when(over < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(over >= 0, F.col("multiplier")).otherwise(F.col("high"))
        moved = moved.withColumn("error", F.coalesce(F.abs(over) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(0.0))).withColumn("low", low).withColumn("high", high)
        step = F.col("multiplier") - over / F.when(F.col("slope") > 0, F.col("slope"))
        # Outside the bracket, or without a slope, halve the bracket (on a scale that fits its width).
        half = F.when((F.col("low") < -1) & (F.col("high") > 1), F.lit(0.0)).when(F.col("low") >= 1, F.sqrt(F.col("low") * F.col("high"))) \
            .when(F.col("high") <= -1, -F.sqrt(F.col("low") * F.col("high"))).otherwise((F.col("low") + F.col("high")) / 2)
        middle = F.when((F.col("low") < -1) & (F.col("high") > 1) & (F.col("multiplier") == 0), F.when(over < 0, 1.0).otherwise(-1.0)).otherwise(half)
        new = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise(middle)
        state = stored(moved.withColumn("multiplier", F.when(F.col("error") > tolerance, new).otherwise(F.col("multiplier"))).select(state.columns), "mix-state")
        if not state.where(F.col("error") > tolerance).limit(1).count():
            break
    return state.select("source", "source_size", "target", "multiplier", "mean_size")


def settle(rated: DataFrame) -> DataFrame:
    """Bring each source's words nearer to its target: while words are over or missing, the largest size that still fits the
    difference gives or takes as many copies as fit, within the whole numbers on either side of its rate."""
    one = Window.partitionBy("source")
    for _ in range(SETTLE_ROUNDS):
        rated = rated.withColumn("off", F.round("target").cast("long") - F.sum(F.col("give") * F.col("size")).over(one))
        room = F.when(F.col("off") > 0, F.ceil("rate") * F.col("n") - F.col("give")).otherwise(F.col("give") - F.floor("rate") * F.col("n"))
        rated = rated.withColumn("room", room)
        able = (F.col("room") > 0) & (F.col("size") > 0)
        # Else the smallest that ends up nearer on the other side.
        rated = rated.withColumn("chosen", F.coalesce(F.max(F.when(able & (F.col("size") <= F.abs("off")), F.col("size"))).over(one),
                                                      F.min(F.when(able & (F.col("size") < 2 * F.abs("off")), F.col("size"))).over(one)))
        change = F.least("room", F.greatest(F.lit(1), F.floor(F.abs("off") / F.col("size")))) * F.signum("off")
        rated = rated.withColumn("give", F.col("give") + F.when(F.col("size") == F.col("chosen"), change).otherwise(0).cast("long")).drop("off", "room", "chosen")
    return rated


def copies(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, most_repeats: int = 2) -> DataFrame:
    """Add ``source_size``, ``target``, ``rate`` and ``copies`` to stored rows ``(id, source, size, pick)``; ``pick`` orders the
    documents of one size."""
    hist = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-hist")
    by_source = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = balance(hist, targets(by_source, weights, budget, most_repeats), most_repeats)
    goals = goals.withColumnRenamed("source", "s")
    rated = hist.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", _rate(most_repeats))
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up_to = F.sum(F.col("rate") * F.col("n")).over(along)
    rated = (rated.withColumn("after", F.floor(up_to + 0.5)).withColumn("before", F.lag("after", 1, 0).over(Window.partitionBy("source").orderBy("size")))
             # Sums of doubles may end a hair beyond a whole number: a size never gets more than its limit.
             .withColumn("give", F.greatest(F.lit(0), F.least(F.col("after") - F.col("before"), F.lit(most_repeats) * F.col("n"))))
             .select("source", "size", "n", "give", "source_size", "target", "rate"))
    rated = settle(rated)
    shown = rated.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "give", "source_size", "target", "rate")
    placed = (sized.join(shown, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
              .withColumn("part", F.pmod("pick", F.ceil(F.col("n") / PART_ROWS))))
    key = ["source", "size", "part"]
    through = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = (placed.groupBy(*key).agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("give").alias("give"))
             .withColumn("seen", F.sum("m").over(through))
             .withColumn("share", F.floor(F.col("give") * F.col("seen") / F.col("n")) - F.floor(F.col("give") * (F.col("seen") - F.col("m")) / F.col("n")))
             .select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), "m", "share"))
    ranked = (placed.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p"))).drop("s", "z", "p")
              .withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("pick", "id"))))
    whole = F.floor(F.col("share") / F.col("m"))
    return (ranked.withColumn("copies", (whole + (F.col("place") <= F.col("share") - whole * F.col("m")).cast("long")).cast("long"))
            .select("id", "source", "size", "source_size", "target", "rate", "copies"))


def measured(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    return docs.select(docs[id_column].alias("id"), docs[source_column].alias("source"), word_count(docs[text_column]).alias("size"),
                       F.xxhash64(docs[id_column], F.lit("mix")).alias("pick"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, most_repeats: int = 2, id_column: str = "doc_id",
        text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``(id, source, size, source_size, target, rate, copies)`` of every document."""
    sized = stored(measured(docs, id_column, text_column, source_column), "mix-sizes")
    return copies(sized, weights, budget, most_repeats).withColumnRenamed("id", id_column)


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **settings) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. Copies are joined back by id, so ids should be unique; of rows that
    share an id (or have none), each gets as many copies as the one with most."""
    taken = (copies(stored(measured(docs, id_column, text_column, source_column), "mix-sizes"), **settings)
             .groupBy(F.col("id").alias("__id")).agg(F.max("copies").alias("__copies")).where("__copies > 0"))
    return (docs.join(taken, docs[id_column].eqNullSafe(taken["__id"]))
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), taken["__copies"].cast("int")))).select(*[docs[c] for c in docs.columns]))


def op9_mixing(spark, folder: str) -> DataFrame:
    """Words that the mix takes of every document, with the targets of its source."""
    from tamiz.llm.store import table
    return mix(table(spark, folder, "documents")).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.round("rate", 9).alias("rate"))
