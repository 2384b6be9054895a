"""Searching lines: matches with context, pattern sets, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V
from tamiz.functions.personal import clip
from tamiz.operators.ordered import CHUNK, running


def search_context(lines: DataFrame, regex: str, context: int = 2, limit: int | None = None) -> DataFrame:
    """Matching lines with the lines around them: ``(file, line_no, match, before, after)``.

    Context comes by an equality join on line numbers around each match, so neither files nor
    matches are gathered on one task; a match carries at most ``2 * context`` lines.
    """
    hits = lines.where(F.col("text").rlike("(?i)" + regex)).select(
        "file", F.col("line_no").alias("at"), F.trim("text").alias("match"))
    if limit is not None:
        hits = hits.orderBy("file", "at").limit(limit)
    around = hits.select("file", "at", "match", F.explode(F.sequence(
        F.col("at") - context, F.col("at") + context)).alias("line_no"))
    near = around.join(lines.select("file", "line_no", "text"), ["file", "line_no"])
    got = near.groupBy("file", "at", "match").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    part = lambda keep: F.array_join(F.transform(
        F.filter("ls", keep), lambda l: l["text"]), "\n")
    return got.select("file", F.col("at").alias("line_no"), "match",
                      part(lambda l: l["line_no"] < F.col("at")).alias("before"),
                      part(lambda l: l["line_no"] > F.col("at")).alias("after"))


def search_summary(lines: DataFrame, regex: str, limit: int) -> DataFrame:
    """Matches, files matched and whether a report of ``limit`` rows is cut."""
    hit = lines.where(F.col("text").rlike("(?i)" + regex))
    return hit.agg(F.count("*").alias("matches"), F.count_distinct("file").alias("files_matched"),
                   (F.count("*") > limit).alias("truncated"))


def match_patterns(lines: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """Lines per symbol with the first of its patterns they match, all symbols in one pass."""
    hits = []
    for symbol, regexes in patterns.items():
        first = F.coalesce(*[F.when(F.col("text").rlike("(?i)" + rx), F.lit(rx)) for rx in regexes])
        hits.append(F.struct(F.lit(symbol).alias("symbol"), first.alias("pattern")))
    found = F.filter(F.array(*hits), lambda h: h["pattern"].isNotNull())
    return (lines.select("file", "line_no", F.trim("text").alias("content"), F.explode(found).alias("h"))
            .select("file", "line_no", "content", "h.symbol", "h.pattern"))


def symbol_patterns(symbol: str, kind: str = "") -> list[str]:
    """Declaration and use patterns of a symbol by kind."""
    return [form.replace("%s", symbol) for form in V.SYMBOL_FORMS.get(kind.lower(), V.SYMBOL_FORMS[""])]


def find_sections(lines: DataFrame, keyword: str, heading: str = r"^#{1,4}\s+(.+)$", chunk: int = CHUNK) -> DataFrame:
    """Lines that hold a word, with the nearest heading above them."""
    marked = lines.where(F.col("text").rlike(heading) | F.lower("text").contains(keyword.lower()))
    title = F.when(F.col("text").rlike(heading), F.trim(F.regexp_extract("text", heading, 1)))
    out = running(marked, ["file"], "line_no", {"section": (title, "last")}, chunk)
    return out.where(F.lower("text").contains(keyword.lower())).select(
        "file", F.coalesce("section", F.lit("")).alias("section"), "line_no", clip(F.col("text"), 120).alias("snippet"))


def undocumented(changes: DataFrame, lines: DataFrame, element: str = "element") -> DataFrame:
    """Changed elements that no documentation line names as a word."""
    words = lines.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("word"))
    return changes.join(words.distinct(), F.lower(F.col(element)) == F.col("word"), "left_anti")


def control_structs(col: Column) -> Column:
    """All controls of a line with an identifier and a text, case ignored: an array of ``(id, label, kind)``."""
    def of(kind: str, rx: str, i: int, t: int) -> Column:
        return F.transform(F.regexp_extract_all(col, F.lit("(?i)" + rx), F.lit(0)), lambda m: F.struct(
            F.regexp_extract(m, "(?i)" + rx, i).alias("id"), F.regexp_extract(m, "(?i)" + rx, t).alias("label"), F.lit(kind).alias("kind")))

    return F.array_distinct(F.flatten(F.array(*[of(*form) for form in V.CONTROL_FORMS])))


def extract_controls(lines: DataFrame, text: str = "text", keys: tuple[str, ...] = ("file", "line_no")) -> DataFrame:
    """Controls with an identifier and a text in markup lines, once per pair of both: where and as what it comes first."""
    found = lines.select(*keys, F.explode(control_structs(F.col(text))).alias("c")).select(*keys, "c.id", "c.label", "c.kind")
    first = found.groupBy("id", "label").agg(F.min_by(F.struct("kind", *keys), F.struct(*keys, "kind")).alias("f"))
    return first.select("id", "label", "f.*")


def link_pairs(html: Column) -> Column:
    """Target and anchor text of the links in a page, as an array of structs."""
    links = F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(0))
    return F.transform(links, lambda a: F.struct(
        F.regexp_extract(a, r'href="([^"]*)"', 1).alias("id"), F.regexp_extract(a, r">([^<]*)<", 1).alias("label")))
