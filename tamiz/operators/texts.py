"""Text registry: free ids per kind, one text per language, links to controls, change routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V
from tamiz.operators.ordered import CHUNK, rank_whole, running, running_sum
from tamiz.session import durable


#: Positions that one bucket of the interval lookup holds; width of a gap without an end.
BUCKET, ENDLESS = 4096, 1 << 40


def free_gaps(existing: DataFrame, low: int, high: int | None, chunk: int = CHUNK) -> DataFrame:
    """Runs of free ids from ``low`` to ``high``: ``(first, width, start)``, ``start`` being the free ids before them. As long as the
    ids in use, however wide the range."""
    used = existing.where(F.col("id") >= low)
    if high is not None:
        used = used.where(F.col("id") <= high)
    used = durable(used.select("id").distinct())
    after = running(used, [], "id", {"prev": (F.col("id"), "last")}, chunk, exclusive=True)
    first = F.coalesce(F.col("prev") + 1, F.lit(low))
    inner = after.select(first.alias("first"), (F.col("id") - first).alias("width"))
    behind = F.coalesce(F.max("id") + 1, F.lit(low))
    last = used.agg(behind.alias("first")).select("first", (F.lit(high + 1) - F.col("first") if high is not None else F.lit(ENDLESS)).alias("width"))
    gaps = durable(inner.unionByName(last).where("width > 0"))
    return running_sum(gaps, [], "first", F.col("width"), "upto", chunk).select("first", "width", (F.col("upto") - F.col("width")).alias("start"))


def _given(requests: DataFrame, existing: DataFrame, low: int, high: int | None, wanted: int, chunk: int) -> DataFrame:
    """``requests(request, kind, pos)`` with the free id at each position; those beyond the last free id are left out."""
    gaps = free_gaps(existing, low, high, chunk).where(F.col("start") < wanted)
    end = F.least(F.col("start") + F.col("width"), F.lit(wanted))
    spread = gaps.select("first", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((end - 1) / BUCKET))).alias("bucket"))
    asked = requests.withColumn("bucket", F.floor((F.col("pos") - 1) / BUCKET))
    return (asked.join(spread, "bucket").where((F.col("pos") > F.col("start")) & (F.col("pos") <= F.col("end")))
            .select("request", "kind", (F.col("first") + F.col("pos") - 1 - F.col("start")).alias("id")))


def allocate_ids(existing: DataFrame, requests: DataFrame, ranges=None, chunk: int = CHUNK) -> DataFrame:
    """An id for every ``(request, kind)``: the lowest free ones of the kind's range in request
    order, filling gaps. A full range overflows into the open one, flagged. ``request`` is a unique
    whole number."""
    ranges = ranges or V.TEXT_RANGES
    existing = existing.select(F.col("id").cast("bigint").alias("id")).distinct()
    strange = requests.where(F.col("kind").isNull() | ~F.col("kind").isin(list(ranges))).select("kind").first()
    if strange:
        raise ValueError(f"unknown text kind: {strange['kind']}")
    ordered = durable(rank_whole(requests, ["kind"], "request", "pos", chunk))
    counts = {r["kind"]: r["n"] for r in ordered.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # known kinds only
    open_kind = next(k for k, (_, high) in ranges.items() if high is None)
    given = None
    for kind, (low, high) in ranges.items():
        if kind not in counts:
            continue
        part = _given(ordered.where(F.col("kind") == kind), existing, low, high, counts[kind], chunk)
        given = part if given is None else given.unionByName(part)
    if given is None:
        return requests.select("request", "kind").withColumn("id", F.lit(None).cast("bigint")).withColumn(
            "overflow", F.lit(False))
    given = durable(given)
    left = durable(requests.select("request", "kind").join(given.select("request"), "request", "left_anti"))
    missing = left.count()
    out = given.withColumn("overflow", F.lit(False))
    if missing:
        taken = existing.unionByName(given.select("id"))
        extra = _given(rank_whole(left, [], "request", "pos", chunk), taken, ranges[open_kind][0], None, missing, chunk)
        out = out.unionByName(extra.withColumn("overflow", F.lit(True)))
    return out


def expand_languages(texts: DataFrame, languages: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per text and active language, leaving out what exists. ``texts(id, lang, text)`` holds
    the translations given; the rest get a placeholder. The languages meet the texts as one list."""
    codes = languages.where("lang IS NOT NULL").agg(F.sort_array(F.collect_set("lang")).alias("codes"))
    if languages.where("lang IS NOT NULL").isEmpty():
        raise ValueError("no active language")
    ids = texts.select("id").distinct().select("id", F.explode(codes.scalar()).alias("lang"))
    placeholder = F.concat(F.lit("[TEXTO_"), "lang", F.lit("]"))
    return (ids.join(texts.select("id", "lang", "text"), ["id", "lang"], "left")
            .join(existing.select("id", "lang"), ["id", "lang"], "left_anti")
            .select("id", "lang", F.coalesce("text", placeholder).alias("text")))


def link_controls(controls: DataFrame, texts: DataFrame, existing: DataFrame) -> DataFrame:
    """A link per control that shows a text, with the page casing existing links already use.
    ``controls(page, control, label)``, ``texts(id, kind, label)``; errors and messages get none."""
    shown = texts.where(F.col("kind") == "screen")
    casing = existing.groupBy(F.upper("page").alias("page_key")).agg(F.max_by("page", "links").alias("known")) \
        if "links" in existing.columns else existing.groupBy(F.upper("page").alias("page_key")).agg(
            F.max("page").alias("known"))
    return (controls.join(shown, "label").withColumn("page_key", F.upper("page")).join(casing, "page_key", "left")
            .select(F.coalesce("known", "page").alias("page"), "control", "id"))


def classify_text_changes(old: DataFrame, new: DataFrame, links: DataFrame) -> DataFrame:
    """Route of every control in ``new(control, text)`` against ``old(control, id, text)``.

    New control with a new text: add text and link. Same control, text edited: update when its id is
    its own, else new id and relink. New control with a text some removed control had: relink.
    """
    uses = links.groupBy("id").agg(F.count("*").alias("uses"))
    both = old.withColumnRenamed("text", "old_text").join(
        new.withColumnRenamed("text", "new_text"), "control", "full_outer").join(uses, "id", "left")
    gone = (both.where(F.col("new_text").isNull()).groupBy(F.col("old_text").alias("new_text"))
            .agg(F.min("id").alias("moved_id")))
    routed = both.where(F.col("new_text").isNotNull()).join(gone, "new_text", "left")
    action = (F.when(F.col("old_text").isNull() & F.col("moved_id").isNotNull(), "relink")
              .when(F.col("old_text").isNull(), "add")
              .when(F.col("old_text") == F.col("new_text"), "same")
              .when(F.coalesce("uses", F.lit(0)) <= 1, "update").otherwise("new id and relink"))
    return routed.select("control", action.alias("action"),
                         F.when(action == "relink", F.col("moved_id")).otherwise(F.col("id")).alias("id"))
