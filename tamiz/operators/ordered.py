"""Ordered operations that stay parallel inside one large group.

A plain window per file puts a whole file on one task. Here a group is cut into chunks of
consecutive positions; each chunk is summarised, the summaries are scanned, and every
chunk starts from the state carried into it. The scan of summaries is cut into spans of `FAN`
chunks in the same way, so no task sees all summaries of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65536
#: Chunks whose summaries one task scans.
FAN = 256


def _cell(order: str, chunk: int) -> Column:
    """First position of the chunk a row falls in, in whole numbers."""
    at = F.col(order).cast("bigint")
    return at - F.pmod(at, F.lit(chunk).cast("bigint"))


def _carried(summary: DataFrame, group: list[str], hows: dict[str, str], chunk: int, levels: int = 1) -> DataFrame:
    """State before each chunk of ``summary(*group, __chunk, __sum_<name>)``: ``__carry_<name>``. How a state is made: the
    ``last`` value that is not null, the ``min`` or the ``sum``."""
    before = lambda cells: Window.partitionBy(*cells).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)

    def scanned(name: str, how: str, cells: list[str]) -> Column:
        value = F.col(f"__sum_{name}")
        return {"last": F.last(value, ignorenulls=True), "min": F.min(value), "sum": F.sum(value)}[how].over(before(cells))

    if not levels:
        return summary.select(*group, "__chunk", *[scanned(n, how, group).alias(f"__carry_{n}") for n, how in hows.items()])
    wide = summary.withColumn("__span", _cell("__chunk", chunk * FAN))
    whole = {"last": lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("__chunk"))), "min": F.min, "sum": F.sum}
    spans = wide.groupBy(*group, "__span").agg(*[whole[how](F.col(f"__sum_{n}")).alias(f"__sum_{n}") for n, how in hows.items()]).withColumnRenamed("__span", "__chunk")
    into = _carried(spans, group, hows, chunk * FAN, levels - 1).select(*group, F.col("__chunk").alias("__span"), *[F.col(f"__carry_{n}").alias(f"__into_{n}") for n in hows])
    inside = wide.select(*group, "__span", "__chunk", *[scanned(n, how, [*group, "__span"]).alias(f"__own_{n}") for n, how in hows.items()])

    def joined(name: str, how: str) -> Column:
        own, into = F.col(f"__own_{name}"), F.col(f"__into_{name}")
        both = {"last": F.coalesce(own, into), "min": F.least(own, into), "sum": F.coalesce(own + into, own, into)}[how]
        return both.alias(f"__carry_{name}")
    return inside.join(into, [*group, "__span"], "left").select(*group, "__chunk", *[joined(n, how) for n, how in hows.items()])


def running(df: DataFrame, group: list[str], order: str, specs: dict[str, tuple[Column, str]],
            chunk: int = CHUNK, exclusive: bool = False) -> DataFrame:
    """Add one column per spec: the last non-null value up to each row ('last') or the least one
    ('min'); ``exclusive`` leaves the row itself out. ``order`` is a whole number, unique in its
    group. The input is read twice: hand in a stored table when it is dear to compute."""
    marked = df.withColumn("__chunk", _cell(order, chunk))
    for name, (value, _) in specs.items():
        marked = marked.withColumn(f"__{name}", value)
    cells = [*group, "__chunk"]
    summary = marked.groupBy(*cells).agg(*[
        (F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.col(order))) if how == "last"
         else F.min(f"__{n}")).alias(f"__sum_{n}")
        for n, (_, how) in specs.items()])
    carried = _carried(summary, group, {n: how for n, (_, how) in specs.items()}, chunk)
    inside = Window.partitionBy(*cells).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    joined = marked.join(carried, cells, "left")
    out = joined.select(*df.columns, *[
        (F.coalesce(F.last(f"__{n}", ignorenulls=True).over(inside), F.col(f"__carry_{n}"))
         if how == "last" else F.least(F.min(f"__{n}").over(inside), F.col(f"__carry_{n}"))).alias(n)
        for n, (_, how) in specs.items()])
    return out


def running_sum(df: DataFrame, group: list[str], order: str, value: Column, name: str,
                chunk: int = CHUNK) -> DataFrame:
    """Inclusive running total of ``value`` in the order of a whole-number column."""
    marked = df.withColumn("__chunk", _cell(order, chunk)).withColumn("__v", value)
    cells = [*group, "__chunk"]
    summary = marked.groupBy(*cells).agg(F.sum("__v").alias("__sum_v"))
    carried = _carried(summary, group, {"v": "sum"}, chunk)
    inside = Window.partitionBy(*cells).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (marked.join(carried, cells)
            .select(*df.columns, (F.sum("__v").over(inside) + F.coalesce(F.col("__carry_v"), F.lit(0))).alias(name)))


def rank_whole(df: DataFrame, group: list[str], order: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Position 1, 2, 3, ... of each row in its group by a unique whole-number column."""
    return running_sum(df, group, order, F.lit(1).cast("bigint"), name, chunk)


def first_rows(df: DataFrame, keys: list[str], order: list, n: int, name: str = "pos") -> DataFrame:
    """First n rows of every key. The rank filter is pushed below the shuffle by Spark, so each
    task sends at most n rows of a key however hot the key is."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= n)
