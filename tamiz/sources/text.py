"""Text sources: numbered lines, client output, logs of commits, diffs, structured files, records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V
from tamiz.operators.ordered import CHUNK, running
from tamiz.operators.validate import Structure

# Characters 0x80-0x9F as the Windows code page reads them; its five unused places stay as they are.
_HIGH = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)]


def decoded(raw: Column, valid: Column) -> Column:
    """Text of bytes: UTF-8 when valid, else the ANSI code page."""
    ansi = F.translate(F.decode(raw, "ISO-8859-1"), "".join(chr(b) for b in range(0x80, 0xA0)), "".join(_HIGH))
    return F.when(valid, F.decode(raw, "UTF-8")).otherwise(ansi)


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Lines ``(file, mtime, line_no, text)`` of files of any size, UTF-8 when a file is valid, else the ANSI code page. A task numbers its rows one after the other, so a line's
    place in its file block is its number less the block's least one; blocks are shifted by the lines
    before them. Only the short table of blocks is shuffled when it can be sent to every task."""
    raw = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"),
        F.monotonically_increasing_id().alias("place")))
    per = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("ok"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"),
                       F.bool_and("ok").over(Window.partitionBy("file")).alias("ok"))
    text = decoded(F.col("raw"), F.col("ok"))
    number = F.col("place") + F.col("shift")
    # A byte-order mark opens a file; anywhere else it is text.
    plain = F.when(number == 1, F.regexp_replace(text, "^\uFEFF", "")).otherwise(text)
    return raw.join(shift, ["file", "block"]).select("file", "mtime", number.alias("line_no"), plain.alias("text"))


def read_result_text(spark: SparkSession, path: str, sep: str = "|", quoted: bool = False) -> DataFrame:
    """Client output with a header line: trimmed cells, no blank and no dashes-only lines."""
    reader = spark.read.option("header", "true").option("sep", sep).option("mode", "PERMISSIVE")
    reader = reader.option("quote", '"') if quoted else reader.option("quote", "")
    df = reader.csv(path)
    df = df.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in df.columns])
    some = F.coalesce(*[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in df.columns]).isNotNull()
    df = df.where(some)
    if quoted:
        return df
    dashes = F.lit(True)
    for c in df.columns:
        dashes = dashes & F.coalesce(F.col(f"`{c}`"), F.lit("-")).rlike("^-+$")
    return df.where(~dashes)


def parse_result_text(lines: DataFrame, sep: str = "|", quoted: bool = False) -> DataFrame:
    """Client output as cells: ``(file, row, column, value)`` of ``(file, line_no, text)``. Every file has a header of its own, its
    first line that is not blank; it meets the file's other lines by the file's name, once a file. Cells are trimmed; blank lines and, in
    the unquoted form, lines of dashes only are left out. A line may have fewer cells than the header (null) or more (dropped)."""
    full = lines.where(F.col("text").isNotNull() & (F.trim("text") != ""))
    if quoted:
        # A cell starts the line or follows a separator; quotes inside quotes are doubled.
        cell = '"(?:[^"]|"")*"'
        one = rf'(?:{cell}|[^{re.escape(sep)}]*)'
        raw = F.regexp_extract_all(F.concat(F.lit(sep), F.col("text")), F.lit(rf"{re.escape(sep)}\s*{one}"), F.lit(0))
        bare = lambda c: F.trim(F.substr(c, F.lit(2), F.length(c)))
        cells = F.transform(raw, lambda c: F.when(bare(c).startswith('"') & bare(c).endswith('"') & (F.length(bare(c)) > 1), F.replace(
            F.substr(bare(c), F.lit(2), F.length(bare(c)) - 2), F.lit('""'), F.lit('"'))).otherwise(bare(c)))
    else:
        cells = F.transform(F.split("text", re.escape(sep)), lambda c: F.trim(c))
    split = full.select("file", "line_no", cells.alias("cells"))
    header = split.groupBy("file").agg(F.min("line_no").alias("head_line"), F.min_by("cells", "line_no").alias("names"))
    body = split.join(header, "file").where(F.col("line_no") > F.col("head_line"))
    if not quoted:
        body = body.where(~F.forall("cells", lambda c: c.rlike("^-+$")))
    paired = F.transform("names", lambda n, i: F.struct(n.alias("column"), F.get("cells", i).alias("value")))
    return body.select("file", F.col("line_no").alias("row"), F.inline(paired))


def parse_commit_log(lines: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Commits ``(file, revision, author, ts, message)`` and their files ``(file, revision, action,
    path, seq)``. Header fields are parted by U+001F; a rename keeps its last path."""
    sep = "\u001f"
    part = F.split("text", sep)
    headers = lines.where(F.col("text").contains(sep))
    commits = headers.select("file", F.get(part, F.lit(0)).alias("revision"), F.get(part, F.lit(1)).alias("author"),
                             F.get(part, F.lit(2)).alias("ts"), F.get(part, F.lit(3)).alias("message"))
    shape = r"^([AMDRT])\d*\s+(.+)$"
    tied = running(lines.select("file", "line_no", "text"), ["file"], "line_no",
                   {"revision": (F.when(F.col("text").contains(sep), F.get(part, F.lit(0))), "last")}, chunk)
    files = tied.where(~F.col("text").contains(sep) & F.col("text").rlike(shape)).select(
        "file", "revision", F.regexp_extract("text", shape, 1).alias("action"),
        F.element_at(F.split(F.regexp_extract("text", shape, 2), "\t"), -1).alias("path"), F.col("line_no").alias("seq"))
    return commits, files


GIT_HEADER = r"^diff --git a/(.+?) b/.*$"
SVN_HEADER = r"^Index: (.+)$"


def parse_diff(lines: DataFrame, header: str = GIT_HEADER, chunk: int = CHUNK) -> DataFrame:
    """Diff text to ``(diff, file, line_no, sign, text)``; lines before the first header are dropped,
    as are the +++ and --- marks."""
    own = F.when(F.col("text").rlike(header), F.trim(F.regexp_extract("text", header, 1)))
    base = lines.select(F.col("file").alias("diff"), "line_no", "text")
    tied = running(base, ["diff"], "line_no", {"file": (own, "last")}, chunk).where("file IS NOT NULL")
    text = F.col("text")
    sign = (F.when(text.startswith("+") & ~text.startswith("+++"), "+")
            .when(text.startswith("-") & ~text.startswith("---"), "-").otherwise(" "))
    return tied.where(~text.rlike(header)).select("diff", "file", "line_no", sign.alias("sign"), "text")


def parse_structured(lines: DataFrame, spec: Structure) -> DataFrame:
    """Lines to the text fields of a structure, with ``file`` and ``line_no``. Positional by start and
    length; delimited by plain splitting, or with quotes when the structure has a text qualifier."""
    text = F.col("text")
    if spec.file_type == "positional":
        cells = [F.substring(text, f.start, f.longitud).alias(f.name) for f in spec.fields]
    elif spec.text_qualifier:
        ddl = ", ".join(f"`{f.name}` string" for f in spec.fields)
        row = F.from_csv(text, F.lit(ddl), {"sep": spec.delimiter, "quote": spec.text_qualifier, "escape": spec.text_qualifier})
        cells = [row[f.name].alias(f.name) for f in spec.fields]
    else:
        import re
        parts = F.split(text, re.escape(spec.delimiter), -1)
        cells = [F.get(parts, F.lit(i)).alias(f.name) for i, f in enumerate(spec.fields)]
    body = lines.where(F.col("line_no") > 1) if spec.tiene_cabecera else lines
    return body.where(text != "").select("file", "line_no", *cells)


def read_structured_file(spark: SparkSession, path: str, spec: Structure) -> DataFrame:
    return parse_structured(read_lines(spark, path), spec)


def parse_terminated(records: DataFrame, columns: list[str], value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Record texts to columns, and the rejects. Cells are parted by the delimiter token; the NULL and
    newline tokens are turned back; a wrong number of cells rejects the record."""
    text = F.regexp_replace(F.col(value), r"^[\r\n]+|[\r\n]+$", "")
    named = records.select(text.alias("__t")).where(F.trim("__t") != "")
    cells = named.withColumn("__c", F.split("__t", r"\Q" + V.COLUMN_DELIMITER + r"\E", -1))
    good = F.size("__c") == len(columns)
    back = lambda c: F.replace(F.replace(c, F.lit(V.CR_TOKEN), F.lit("\r")), F.lit(V.LF_TOKEN), F.lit("\n"))
    rows = cells.where(good).select(*[
        F.when(F.get("__c", F.lit(i)) != V.NULL_TOKEN, back(F.get("__c", F.lit(i)))).alias(c) for i, c in enumerate(columns)])
    rejects = cells.where(~good).select(F.size("__c").alias("cells"), F.col("__t").alias("text"))
    return rows, rejects


def read_terminated_rows(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return parse_terminated(spark.read.option("lineSep", V.ROW_END).text(path), columns)
