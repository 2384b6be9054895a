"""Error logs: lines to events, events to signatures, signatures to reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V
from tamiz.functions import logtext as L
from tamiz.functions.personal import clip, redact_literals
from tamiz.operators.ordered import CHUNK, first_rows, running, running_sum
from tamiz.session import durable


def _kept(kind: Column, level: Column, text: Column, stamp: Column, levels: list[str],
          since: str | None) -> Column:
    """Whether a header opens an event or is passed over together with its lines."""
    wanted = (level == "") | L.level_wanted(level, levels)
    typed = (kind == L.LABELLED) | (level != "") | L.names_exception(text)
    keep = wanted & typed
    if since is not None:
        late = L.stamp_time(stamp) >= F.to_timestamp(F.lit(since))
        keep = keep & F.coalesce(late, F.lit(True))
    return keep


def tag_headers(lines: DataFrame, levels: list[str] | None = None, since: str | None = None,
                chunk: int = CHUNK) -> DataFrame:
    """Headers in force of ``(file, line_no, text)``: kind, stamp, whether the event is kept and the
    line of the next header.

    While a kept labelled header is open only another labelled header ends it; a bare exception line
    opens an event only where its file has shown no header yet. Only the few lines that could be
    headers are ordered, without their text, and they are stored first so the log is read once.
    """
    levels = levels or V.LOG_LEVELS
    text = F.col("text")
    kind = F.when(L.is_labelled(text), L.LABELLED).when(L.is_stamped(text), L.STAMPED).when(L.names_exception(text), L.PLAIN)
    # Staged, so that each part of a header is read once.
    heads = lines.select("file", "line_no", "text", kind.alias("kind")).where("kind IS NOT NULL")
    heads = heads.select("*", F.when(F.col("kind") != L.PLAIN, L.header_level(text)).otherwise("").alias("level"),
                         F.when(F.col("kind") != L.PLAIN, L.header_stamp(text)).otherwise("").alias("stamp"))
    kept = _kept(F.col("kind"), F.col("level"), text, F.col("stamp"), levels, since)
    candidates = durable(heads.select("file", "line_no", "kind", "stamp",
                                      ((F.col("kind") == L.PLAIN) | kept).alias("kept")))

    is_lab, is_plain = F.col("kind") == L.LABELLED, F.col("kind") == L.PLAIN
    seen = running(candidates, ["file"], "line_no", {
        "open_lab": (F.when(is_lab, F.col("kept")), "last"),
        "first_head": (F.when(~is_plain, F.col("line_no")), "min"),
        "first_bare": (F.when(is_plain, F.col("line_no")), "min")}, chunk)
    inside = F.coalesce(F.col("open_lab"), F.lit(False))
    heads = seen.where(is_lab | ((F.col("kind") == L.STAMPED) & ~inside)
                       | (is_plain & F.col("first_head").isNull() & (F.col("line_no") == F.col("first_bare"))))
    # Stored, as the way back reads it twice.
    heads = durable(heads.select("file", "line_no", "kind", "stamp", "kept", (-F.col("line_no")).alias("back")))
    return running(heads, ["file"], "back", {"next_line": (F.col("line_no"), "last")}, chunk,
                   exclusive=True).drop("back")


def assemble_events(lines: DataFrame, levels: list[str] | None = None, since: str | None = None,
                    chunk: int = CHUNK, most_lines: int | None = V.EVENT_LINES) -> DataFrame:
    """Lines to ``(file, line_no, kind, stamp, lines)``: a header and what follows it, ``most_lines``
    lines at most, None for all; lines of a passed-over header are passed over too."""
    heads = tag_headers(lines, levels, since, chunk).where("kept")
    if most_lines is None:
        heads = heads.join(lines.groupBy("file").agg(F.max("line_no").alias("end_line")), "file")
        most = F.col("end_line")
    else:
        most = F.col("line_no") + (most_lines - 1)
    members = heads.select("file", F.col("line_no").alias("event_line"), "kind", "stamp", F.explode(
        F.sequence(F.col("line_no"), F.least(most, F.col("next_line") - 1))).alias("line_no"))
    return (members.join(lines.select("file", "line_no", "text"), ["file", "line_no"])
            .groupBy("file", "event_line", "kind", "stamp")
            .agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
            .select("file", F.col("event_line").alias("line_no"), "kind", "stamp",
                    F.col("ls.text").alias("lines")))


def describe_events(events: DataFrame) -> DataFrame:
    """Add code, origin, screen, message and the signature of each event."""
    lines, kind = F.col("lines"), F.col("kind")
    # Written column by column: the optimizer keeps what several later columns need as one step.
    return (events.withColumn("exception", L.error_code(lines, kind))
            .withColumn("origin", L.own_frame(lines))
            .withColumn("screen", L.screen(lines))
            .withColumn("message", L.message(lines, kind))
            .withColumn("hash", L.signature(F.col("exception"), F.col("origin"), F.col("message"))))


def aggregate_signatures(described: DataFrame) -> DataFrame:
    """One row per signature. Only fixed-size state is kept per signature, so a hot one is combined
    before the shuffle; its files and samples are separate tables."""
    at = F.struct("file", "line_no")
    seen = F.nullif(F.col("stamp"), F.lit(""))
    shown = F.nullif(F.col("screen"), F.lit(""))
    agg = described.groupBy("hash").agg(
        F.count("*").alias("count"),
        F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"),
        F.coalesce(F.min_by(shown, F.when(shown.isNotNull(), at)), F.lit("")).alias("screen"),
        F.min_by(F.struct("exception", "origin", "message"), at).alias("first"))
    return agg.select("hash", F.col("first.exception").alias("exception"), F.col("first.origin").alias("origin"),
                      "screen", clip(redact_literals(F.col("first.message")), 300).alias("message"),
                      "count", "first_seen", "last_seen")


def signature_files(described: DataFrame) -> DataFrame:
    return described.groupBy("hash", "file").agg(F.count("*").alias("events"))


def signature_samples(described: DataFrame, n: int = 2) -> DataFrame:
    """First n occurrences of every signature, redacted and cut to 600 characters."""
    top = first_rows(described, ["hash"], ["file", "line_no"], n, "sample")
    text = clip(redact_literals(F.array_join("lines", " | ")), 600)
    return top.select("hash", "sample", "stamp", "file", "line_no", text.alias("text"))


def top_signatures(agg: DataFrame, k: int = 30) -> DataFrame:
    return agg.orderBy(F.desc("count"), "hash").limit(k)


def scan_figures(lines: DataFrame) -> DataFrame:
    """One row: files and lines that were scanned, and whether a cap (`scan_cap`) has cut any. Without text, so only the columns that
    tell are read."""
    cut = F.col("scan_truncated") if "scan_truncated" in lines.columns else F.lit(False)
    per = lines.groupBy("file").agg(F.count("*").alias("n"), F.bool_or(cut).alias("cut"))
    return per.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines_scanned"), F.coalesce(F.bool_or("cut"), F.lit(False)).alias("scan_truncated"))


def scan_summary(described: DataFrame, agg_k: int = 30, lines: DataFrame | None = None) -> DataFrame:
    """One row: totals, formats met and whether the report is cut. No events give zeros. With the scanned ``lines`` also
    files, lines and the cut of the scan."""
    per = described.groupBy("hash", "kind").agg(F.count("*").alias("n"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
                    F.count_distinct("hash").alias("distinct_signatures"),
                    F.array_sort(F.collect_set("kind")).alias("kinds"))
    formats = (F.when(F.size("kinds") == 0, V.UNKNOWN_FORMAT).when(F.size("kinds") == 1, F.get("kinds", F.lit(0)))
               .otherwise(F.concat(F.lit("mixto ("), F.array_join("kinds", ", "), F.lit(")"))))
    out = total.select("total_events", "distinct_signatures", formats.alias("format_detected"),
                       (F.col("distinct_signatures") > agg_k).alias("truncated"))
    if lines is None:
        return out
    figures = scan_figures(lines)
    return out.select("*", *[figures.select(c).scalar().alias(c) for c in figures.columns])


def scan_cap(lines: DataFrame, max_lines: int) -> DataFrame:
    """First ``max_lines`` lines over the files newest first (``mtime``), without sorting lines:
    per-file counts give each file its allowance. Adds ``scan_truncated``."""
    files = (lines.groupBy("file", "mtime").agg(F.max("line_no").alias("n"))
             .withColumn("age", -F.unix_micros("mtime")))
    # Files with one time are taken by a digest of their names, whose first digits part them into cells that are ranked apart.
    place = running_sum(
        files.groupBy("age").agg(F.sum("n").alias("n")), [], "age", F.col("n"), "upto", 3600 * 1000000)
    named = files.withColumn("digest", F.md5(F.col("file").cast("binary"))).withColumn("cell", F.substring("digest", 1, 3))
    earlier = Window.partitionBy("age").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = named.groupBy("age", "cell").agg(F.sum("n").alias("n")).select("age", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("cell_start"))
    slices = cells.join(place.select("age", (F.col("upto") - F.col("n")).alias("start")), "age").select("age", "cell", (F.col("start") + F.col("cell_start")).alias("start"))
    files = named
    same = Window.partitionBy("age", "cell").orderBy("digest", "file").rowsBetween(Window.unboundedPreceding, -1)
    budget = (files.join(slices, ["age", "cell"])
              .withColumn("used", F.col("start") + F.coalesce(F.sum("n").over(same), F.lit(0)))
              .select("file", F.greatest(F.lit(0), F.lit(max_lines) - F.col("used")).alias("allowed"),
                      (F.col("used") + F.col("n") > max_lines).alias("scan_truncated")))
    return lines.join(budget, "file").where(F.col("line_no") <= F.col("allowed")).drop("allowed")


def marked_tickets(tickets: DataFrame, title: str = "title") -> DataFrame:
    hit = F.regexp_extract(title, V.TICKET_MARKER, 1)
    return tickets.where(hit != "").select(hit.alias("hash")).distinct()


def new_signatures(agg: DataFrame, tickets: DataFrame) -> DataFrame:
    """Signatures with a flag: already in an open ticket, or new."""
    known = marked_tickets(tickets).withColumn("known", F.lit(True))
    return agg.join(known, "hash", "left").withColumn("is_new", F.col("known").isNull()).drop("known")


def triage(agg: DataFrame, rules: list[tuple[str, str, int]], default: tuple[str, int]) -> DataFrame:
    """Category by the first rule ``(category, pattern, severity)`` met in code or message;
    priority is count times severity."""
    text = F.concat_ws(" ", "exception", "message")
    category, severity = F.lit(default[0]), F.lit(default[1])
    for name, rx, weight in reversed(rules):
        hit = text.rlike(rx)
        category = F.when(hit, F.lit(name)).otherwise(category)
        severity = F.when(hit, F.lit(weight)).otherwise(severity)
    return agg.withColumn("category", category).withColumn("priority", F.col("count") * severity)


def recount_check(lines: DataFrame, events: DataFrame, least_lines: int = 10000, ratio: int = 1000) -> DataFrame:
    """Files where many lines gave hardly any event: the format was probably not understood."""
    size = lines.groupBy("file").agg(F.max("line_no").alias("lines"))
    got = events.groupBy("file").agg(F.count("*").alias("events"))
    n = F.coalesce(F.col("events"), F.lit(0))
    return (size.join(got, "file", "left").withColumn("events", n)
            .withColumn("doubtful", (F.col("lines") >= least_lines) & (F.col("lines") > F.col("events") * ratio)))
