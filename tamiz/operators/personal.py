"""Personal data: which columns to mask, masking itself, inventories and leak checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V
from tamiz.functions import personal as P
from tamiz.functions.types import is_clear_type
from tamiz.session import durable, local_rows

MASK, CLEAR, UNRESOLVED = "mask", "clear", "unresolved"


@dataclass(frozen=True)
class Policy:
    """How results are treated: mode off, audit or enforce; transform hash or suppress."""

    mode: str = "off"
    transform: str = "hash"
    patterns: tuple[str, ...] = tuple(V.NAME_PATTERNS)
    parametric: tuple[str, ...] = ()

    @staticmethod
    def build(mode="off", transform="hash", base=None, add=(), remove=(), parametric=()) -> "Policy":
        """Base patterns plus additions minus removals. No readable base masks every column."""
        start = V.NAME_PATTERNS if base is None else base
        gone = {p.upper() for p in remove}
        kept = [p.upper() for p in [*(start or ["*"]), *add] if p.upper() not in gone]
        return Policy(mode, transform, tuple(kept), tuple(t.upper() for t in parametric))


@dataclass
class MaskReport:
    mode: str
    tables: list[str] = field(default_factory=list)
    masked: list[str] = field(default_factory=list)
    unresolved: list[str] = field(default_factory=list)
    suspect: list[str] = field(default_factory=list)
    predicate_warning: list[str] = field(default_factory=list)
    row_count: int | None = None
    rows_truncated: bool | None = None
    error: str | None = None


def classify_columns(wanted: DataFrame, catalog: DataFrame, policy: Policy, keys: list[str] = ()) -> DataFrame:
    """Verdict and reason for ``wanted(column, table, *keys)``, one row per column and key.

    ``catalog`` holds ``table, column, type, pk_flag, pk_pos, fk, pii, safe``; flags may be NULL.
    With several tables in scope the most restrictive one wins.
    """
    defs = catalog.select(
        F.upper("table").alias("__t"), F.upper("column").alias("__c"),
        (F.coalesce(F.col("pii"), F.lit(False)) | ~F.coalesce(F.col("safe"), F.lit(True))).alias("__marked"),
        F.coalesce(F.col("safe"), F.lit(False)).alias("__safe"),
        (F.coalesce(F.col("pk_flag"), F.lit(False)) | (F.coalesce(F.col("pk_pos"), F.lit(0)) > 0)
         | F.coalesce(F.col("fk"), F.lit(False)) | is_clear_type(F.col("type"))).alias("__typed"))
    col = F.upper(F.trim("column"))
    joined = wanted.withColumn("__col", col).join(
        defs, (F.upper("table") == F.col("__t")) & (F.col("__col") == F.col("__c")), "left")
    judged = joined.groupBy(*keys, "column", "__col").agg(
        F.count("__t").alias("defs"),
        F.bool_or("__marked").alias("marked"), F.bool_and("__safe").alias("safe"),
        F.bool_and(F.col("__t").isin(list(policy.parametric)) if policy.parametric else
                   F.when(F.col("__t").isNotNull(), False)).alias("parametric"),
        F.bool_and("__typed").alias("typed"))
    named = F.col("__col").rlike(P.name_regex(list(policy.patterns)))
    say = lambda v, r: F.struct(F.lit(v).alias("v"), F.lit(r).alias("r"))
    verdict = (F.when(F.col("marked"), say(MASK, "flag"))
               .when((F.col("defs") > 0) & F.col("safe"), say(CLEAR, "flag"))
               .when(named, say(MASK, "name"))
               .when(F.col("defs") == 0, say(UNRESOLVED, "no definition"))
               .when(F.col("parametric"), say(CLEAR, "parametric"))
               .when(F.col("typed"), say(CLEAR, "type"))
               .otherwise(say(MASK, "text")))
    return judged.withColumn("__v", verdict).select(
        *keys, "column", F.col("__v.v").alias("verdict"), F.col("__v.r").alias("reason"))


def _shape_counts(form: Column, text: Column, prefix: str) -> list[Column]:
    counts = [F.count_if(form == s).alias(f"{prefix}_{s}") for s in [*V.STRONG_SHAPES, *V.WEAK_SHAPES]]
    return [*counts, F.count(text).alias(f"{prefix}_n"),
            F.bool_and(P.is_plain_number(text)).alias(f"{prefix}_plain")]


def _dominant(prefix: str) -> Column:
    """Form a column shows: any strong hit, else the most frequent weak form with its share."""
    at = lambda s: F.col(f"{prefix}_{s}")
    strong = [F.when(at(s) > 0, F.lit(s)) for s in V.STRONG_SHAPES]
    weak = [F.when((at(s) > 0) & (at(s) >= at("n") * V.WEAK_SHARE), at(s)) for s in V.WEAK_SHAPES]
    best = F.greatest(*weak)
    return F.coalesce(*strong, *[F.when((w == best) & (w > 0), F.lit(s)) for s, w in zip(V.WEAK_SHAPES, weak)])


def _hits(prefix: str, form: Column) -> Column:
    out = F.lit(0).cast("bigint")
    for s in [*V.STRONG_SHAPES, *V.WEAK_SHAPES]:
        out = F.when(form == s, F.col(f"{prefix}_{s}")).otherwise(out)
    return out


def scan_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """One pass over the rows: ``(column, form, hits, non_blank, all_plain)`` for every column.

    Cells are turned into rows and counted per column before any shuffle, so the work per cell and
    the generated code stay the same for wide tables.
    """
    types = dict(df.dtypes)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), P.as_text(F.col(f"`{c}`"), types[c]).alias("value"))
                      for c in columns])
    shapes = shape_table(df.select(F.inline(cells)), ["column"])
    named = local_rows(df.sparkSession, [(c,) for c in columns], "column string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return named.join(shapes, "column", "left").select("column", "form", zero("hits"), zero("non_blank"), "all_plain")


def resolve_unresolved(scan: DataFrame) -> DataFrame:
    """Decide columns without a definition by the shape of their values."""
    plain = F.coalesce(F.col("all_plain"), F.lit(False))
    return scan.select(
        "column", "form",
        F.when(F.col("form").isNull() & (F.col("non_blank") > 0) & plain, CLEAR).otherwise(MASK).alias("verdict"),
        F.when(F.col("form").isNotNull(), F.concat(F.lit("form "), F.col("form")))
        .when(F.col("non_blank") == 0, F.lit("blank"))
        .when(plain, F.lit("plain numbers")).otherwise(F.lit("other values")).alias("reason"))


def masked_value(value: Column, name: str, dtype: str, policy: Policy, key: bytes) -> Column:
    """Stand-in for a value of the named output column; NULL and blank stay."""
    text = P.as_text(value, dtype)
    stand_in = F.lit(V.SUPPRESSED) if policy.transform == "suppress" else P.pseudonym(text, name, key)
    return F.when(P.is_blank(text), text).otherwise(stand_in).alias(name)


def predicate_leak(spark, predicates: list[str], tables: list[str], catalog: DataFrame,
                   policy: Policy) -> list[str]:
    """Filtered columns that the policy masks: their values can be inferred from any output."""
    if not predicates:
        return []
    pairs = [(c, t) for c in predicates for t in (tables or [None])]
    judged = classify_columns(local_rows(spark, pairs, "column string, table string"), catalog, policy)
    hit = {r["column"] for r in judged.where(F.col("verdict") == MASK).collect()}
    return [c for c in predicates if c in hit]


def masked_origins(spark, origins: dict[str, set[tuple[str, str]]], catalog: DataFrame, policy: Policy) -> list[str]:
    """Keys of ``origins`` with a ``(table, column)`` that the policy masks."""
    rows = [(k, c, t) for k, pairs in origins.items() for t, c in sorted(pairs)]
    if not rows:
        return []
    wanted = local_rows(spark, rows, "place string, column string, table string")
    return [r["place"] for r in classify_columns(wanted, catalog, policy, ["place"]).where(F.col("verdict") == MASK).select("place").distinct().collect()]


def mask(df: DataFrame, tables: list[str], catalog: DataFrame, policy: Policy, key: bytes,
         predicates: list[str] = (), origins: list[set[tuple[str, str]]] | None = None) -> tuple[DataFrame, MaskReport]:
    """Mask a result under the policy. Rows must be stable between runs: the value scan and the
    masking read them one after the other. ``origins``: for each column, by place, the ``(table, column)`` it is made of
    (`lineage`); a column with a masked origin is masked."""
    spark, names = df.sparkSession, df.columns
    report = MaskReport(policy.mode, tables=list(tables))
    if policy.mode == "off":
        return df, report
    # Columns go by position: a result may hold one name twice.
    places = [f"c{i}" for i in range(len(names))]
    work = df.toDF(*places)
    pairs = [(c, t) for c in dict.fromkeys(names) for t in (tables or [None])]
    wanted = local_rows(spark, pairs, "column string, table string")
    judged = {r["column"]: r["verdict"] for r in classify_columns(wanted, catalog, policy).collect()}
    verdict = {p: judged[n] for p, n in zip(places, names)}
    name_of = dict(zip(places, names))
    for p in masked_origins(spark, dict(zip(places, origins or [])), catalog, policy):
        verdict[p] = MASK
    report.unresolved = [name_of[p] for p in places if verdict[p] == UNRESOLVED]
    suspect = set()
    open_places = [p for p in places if verdict[p] != MASK]
    if open_places:
        for r in resolve_unresolved(scan_columns(work, open_places)).collect():
            p = r["column"]
            if verdict[p] == UNRESOLVED:
                verdict[p] = r["verdict"]
            if verdict[p] == CLEAR and r["form"] is not None:
                suspect.add(p)
                verdict[p] = MASK
    report.suspect = [name_of[p] for p in places if p in suspect]
    report.masked = [name_of[p] for p in places if verdict[p] == MASK]
    report.predicate_warning = predicate_leak(spark, list(predicates), list(tables), catalog, policy)
    if policy.mode == "audit":
        return df, report
    types = dict(work.dtypes)
    return work.select(*[masked_value(F.col(p), name_of[p], types[p], policy, key) if verdict[p] == MASK
                         else F.col(p).alias(name_of[p]) for p in places]), report


def sample_columns(df: DataFrame, name: str, n: int = 50, order: list[str] | None = None) -> DataFrame:
    """First n rows of a table as ``(table, column, value)``: in the stated order, else any n rows."""
    df = df.orderBy(*order) if order else df
    types = dict(df.dtypes)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), P.as_text(F.col(c), types[c]).alias("value"))
                      for c in df.columns])
    return df.limit(n).select(F.lit(name).alias("table"), F.inline(cells))


def shape_table(values: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, form, hits, non_blank, all_plain)`` of a long ``value`` table."""
    text = F.nullif(P.strip(F.col("value")), F.lit(""))
    staged = values.select(*keys, text.alias("t")).withColumn("f", P.form_of(F.col("t")))
    agg = staged.groupBy(*keys).agg(*_shape_counts(F.col("f"), F.col("t"), "c"))
    form = _dominant("c")
    return agg.withColumn("form", form).select(*keys, "form", _hits("c", F.col("form")).alias("hits"),
                      F.col("c_n").alias("non_blank"), F.col("c_plain").alias("all_plain"))


def column_inventory(catalog: DataFrame, policy: Policy, samples: DataFrame | None = None) -> DataFrame:
    """Every catalog column with verdict and reason; sampled clear columns are judged again by
    their values. No sampled value is in the output."""
    wanted = catalog.select("table", "column", F.upper("table").alias("owner"))
    base = classify_columns(wanted, catalog, policy, ["owner"]).withColumnRenamed("owner", "table")
    if samples is None:
        return base.select("*", F.lit(None).cast("string").alias("form"), F.lit(None).cast("bigint").alias("hits"),
                           F.lit(None).cast("bigint").alias("sampled"), F.lit(False).alias("suspect"))
    shapes = shape_table(samples, ["table", "column"]).select(
        F.upper("table").alias("table"), F.upper("column").alias("__c"), "form", "hits", "non_blank")
    out = base.withColumn("__c", F.upper("column")).join(shapes, ["table", "__c"], "left")
    suspect = (F.col("verdict") == CLEAR) & F.col("form").isNotNull()
    flag = F.coalesce(suspect, F.lit(False))
    return out.select(
        "table", "column",
        F.when(flag, MASK).otherwise(F.col("verdict")).alias("verdict"),
        F.when(flag, F.concat(F.lit("form "), F.col("form"))).otherwise(F.col("reason")).alias("reason"),
        F.when(flag, F.col("form")).alias("form"), F.when(flag, F.col("hits")).alias("hits"),
        F.when(flag, F.col("non_blank")).alias("sampled"), flag.alias("suspect"))


def inventory_totals(inventory: DataFrame) -> DataFrame:
    """Columns, clear, masked and suspect per table, with a grand total row (table NULL)."""
    return inventory.rollup("table").agg(
        F.count("*").alias("columns"), F.count_if(F.col("verdict") == CLEAR).alias("clear"),
        F.count_if(F.col("verdict") != CLEAR).alias("masked"), F.count_if("suspect").alias("suspect"))


def personal_totals(df: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """Personal values found in free text, per key and form."""
    counts = df.select(*keys, *[c.alias(n) for n, c in P.personal_counts(F.col(column)).items()])
    return counts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in ("dni", "nie", "iban", "email")])


def gate_reason(column: str, path: str, exempt: tuple[str, ...] = ()) -> Column:
    """Form of personal data that stops a row at the gate, or NULL."""
    counts = P.personal_counts(F.col(column))
    reason = F.coalesce(*[F.when(c > 0, F.lit(n)) for n, c in counts.items()])
    for prefix in exempt:
        reason = F.when(F.col(path).startswith(prefix), F.lit(None)).otherwise(reason)
    return reason


def personal_data_gate(df: DataFrame, column: str, path: str, exempt: tuple[str, ...] = ()) -> DataFrame:
    """The input unchanged, failing at run time on the first row that holds personal data; the
    failure names the form, never the value. Rows under an exempt path prefix pass.

    The check is a filter, so it runs whatever columns are read from the result, and for a bare count."""
    reason = gate_reason(column, path, exempt)
    fail = F.raise_error(F.concat(F.lit("personal data of form "), reason, F.lit(" in "), F.col(path)))
    return df.where(F.when(reason.isNotNull(), fail.cast("boolean")).otherwise(F.lit(True)))


def strictest_mode(modes: DataFrame) -> DataFrame:
    """Strictest mode per workspace from ``(workspace, mode, declared)``. A missing model that was
    declared is indeterminate, one expected only by convention is off."""
    order = ["off", "audit", "enforce", "indeterminate"]
    mode = F.when(F.col("mode").isNull(), F.when(F.col("declared"), "indeterminate").otherwise("off")).otherwise(
        F.when(F.col("mode").isin(order), F.col("mode")).otherwise("indeterminate"))
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), mode) - 1
    return (modes.groupBy("workspace").agg(F.max(rank).alias("rank"))
            .select("workspace", F.element_at(F.array(*[F.lit(m) for m in order]), (F.col("rank") + 1).cast("int"))
                    .alias("mode"), (F.col("rank") >= 1).alias("active")))


def rule_scan(lines: DataFrame, rules=None, kind: str = "web") -> DataFrame:
    """One finding per rule and line of ``(file, line_no, text)``. The rules are a short driver
    list, so they become expressions of one projection, each pattern compiled once. Files in build
    folders are not judged."""
    built = "|".join(re.escape(f) for f in V.BUILD_FOLDERS)
    lines = lines.where(~F.col("file").rlike(rf"(?i)(?:^|[\\/])(?:{built})[\\/]"))
    rules = V.CODE_RULES if rules is None else rules
    ext = F.lower(F.regexp_extract("file", r"(\.[^.\\/]+)$", 1))
    hits = [F.when(ext.isin(exts) & F.col("text").rlike(rx),
                   F.struct(F.lit(rid).alias("id"), F.lit(sev).alias("severity")))
            for rid, sev, rx, exts, web_only in rules if kind == "web" or not web_only]
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return (lines.select("file", "line_no", "text", F.explode(found).alias("hit"))
            .select("file", "line_no", "hit.id", "hit.severity",
                    P.clip(F.col("text"), 100).alias("snippet")))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))


_WORDS = r"[^\p{L}\p{N}]+"
#: Kinds of keys that phrases are looked up by: an inner word, a window of the least length of a phrase, and the piece in the middle of
#: a stretch of text that tells whether one of the windows in it may be wanted.
WORD, WINDOW, PIECE = 0, 1, 2
STRIDE = V.PHRASE_MIN // 2
#: A key marks three bits in one cell of 64; keys that share a cell at most, unless that took more than 8 MB of cells.
KEYS_A_CELL, MOST_CELLS = 4, 1 << 20


def _key(kind: int | Column, token: Column) -> Column:
    return F.xxhash64(F.lit(kind) if isinstance(kind, int) else kind, token)


def _cell_and_bits(key: Column, cells: int) -> tuple[Column, Column]:
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(key, n).bitwiseAND(63).cast("int")) for n in (0, 6, 12)]
    return F.shiftrightunsigned(key, 18).bitwiseAND(cells - 1), reduce(lambda a, b: a.bitwiseOR(b), bits)


def _marked(wanted: DataFrame):
    """A test of keys that all keys of the table ``(kind, token)`` pass and few others. The executors make its bits, whose number is
    bounded, and the plan reads them as one value of a subquery."""
    spark = wanted.sparkSession
    pieces = F.transform(F.sequence(F.lit(1), F.lit(STRIDE)), lambda i: _key(PIECE, F.substr("token", i + 1, F.lit(STRIDE))))
    keys = wanted.select(F.explode(F.when(F.col("kind") == WINDOW, F.concat(F.array(_key(WINDOW, F.col("token"))), pieces))
                                   .otherwise(F.array(_key(F.col("kind"), F.col("token"))))).alias("key"))
    cells = min(MOST_CELLS, 1 << (keys.count() // KEYS_A_CELL).bit_length())
    cell, bits = _cell_and_bits(F.col("key"), cells)
    filled = keys.select(cell.alias("cell"), bits.alias("bits")).unionByName(spark.range(cells).select(F.col("id").alias("cell"), F.lit(0).cast("bigint").alias("bits")))
    field = (filled.groupBy("cell").agg(F.bit_or("bits").alias("bits")).agg(F.sort_array(F.collect_list(F.struct("cell", "bits"))).alias("all"))
             .select(F.col("all.bits")).scalar())

    def test(key: Column) -> Column:
        at, mask = _cell_and_bits(key, cells)
        return F.get(field, at.cast("int")).bitwiseAND(mask) == mask
    return test


def _met(lines: DataFrame, wanted: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys, text, __key)``: the keys among those of ``wanted`` that a text holds, each once, and a few others."""
    marked = _marked(wanted)
    has = wanted.agg(*[F.count_if(F.col("kind") == kind).alias(str(kind)) for kind in (WORD, WINDOW)]).first()
    words = lines.select(*keys, text, F.explode(F.array_distinct(F.split(text, _WORDS))).alias("__token")).select(*keys, text, _key(WORD, F.col("__token")).alias("__key"))
    found = [words.where(marked(F.col("__key")))]
    if has[str(WINDOW)]:
        # Stretches begin every STRIDE characters and overlap, so each window lies in the one that begins at it or closely before it.
        stretch = rf"(?s)(?=(.{{{V.PHRASE_MIN},{V.PHRASE_MIN + STRIDE - 1}}})).{{{STRIDE}}}"
        parts = (lines.select(*keys, text, F.posexplode(F.regexp_extract_all(text, F.lit(stretch), F.lit(1))).alias("__at", "__part"))
                 .where(marked(_key(PIECE, F.substring("__part", STRIDE + 1, STRIDE)))))
        windows = parts.select(*keys, text, "__at", F.posexplode(F.array(*[F.substring("__part", i + 1, V.PHRASE_MIN) for i in range(STRIDE)])).alias("__in", "__token"))
        # A window that comes again in its text counts at its first place.
        first = F.instr(F.col(text), F.col("__token")) == F.col("__at") * STRIDE + F.col("__in") + 1
        windows = windows.where((F.length("__token") == V.PHRASE_MIN) & marked(_key(WINDOW, F.col("__token")))).where(first)
        found = found[:bool(has[str(WORD)])] + [windows.select(*keys, text, _key(WINDOW, F.col("__token")).alias("__key"))]
    return reduce(DataFrame.unionByName, found)


def _looked_up_by(lines: DataFrame, phrases: DataFrame, text: str) -> DataFrame:
    """``(phrase, kind, token)``: the one key of each phrase, that the lines hold least often. Phrases that no line can hold are left out
    where that is known."""
    split = F.split("phrase", _WORDS)
    words = F.array_distinct(F.filter(F.slice(split, F.lit(2), F.greatest(F.size(split) - 2, F.lit(0))), lambda w: w != ""))
    windows = F.array_distinct(F.regexp_extract_all("phrase", F.lit(rf"(?s)(?=(.{{{V.PHRASE_MIN}}}))."), F.lit(1)))
    of_kind = lambda kind, tokens: F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))
    wanted = phrases.select("phrase").where(F.length("phrase") >= V.PHRASE_MIN).distinct().select("phrase", words.alias("words"))
    wanted = durable(wanted.select(F.monotonically_increasing_id().alias("id"), "phrase",
                                   F.when(F.size("words") > 0, of_kind(WORD, F.col("words"))).otherwise(of_kind(WINDOW, windows)).alias("keys")))
    chosen = wanted.where(F.size("keys") == 1).select("phrase", F.col("keys")[0].alias("key"))
    several = wanted.where(F.size("keys") > 1)
    if not several.isEmpty():
        choices = several.select("id", F.explode("keys").alias("key")).withColumn("__key", _key(F.col("key.kind"), F.col("key.token")))
        counted = _met(lines, choices.select("key.*").distinct(), [], text).groupBy("__key").agg(F.count("*").alias("n"))
        rarest = (choices.join(counted, "__key", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("best"))
                  .where("best.n > 0").select("id", "best.key"))
        chosen = chosen.unionByName(several.select("id", "phrase").join(rarest, "id").select("phrase", "key"))
    return chosen.select("phrase", "key.*")


def contains_phrase(lines: DataFrame, phrases: DataFrame, keys: list[str], text: str = "text", a_pass: int | None = None) -> DataFrame:
    """Lines that hold a phrase literally: ``(keys, text, phrase)``, one row for each line and phrase, without comparing every
    line with every phrase. Shorter phrases than twelve characters are left out.

    The words strictly inside a phrase appear as whole words in any text that holds it (its first and last may be cut there), so
    a phrase is looked up by one of them. A phrase with no inner word is looked up by one of its windows of twelve characters. Of
    several, the one that the lines hold least often is taken. The keys of a text are tested against a field of bits, so few that no
    phrase is looked up by go further; the rest meet the phrases in one equality join, and every candidate is verified there.
    Phrases are never brought to the driver and any number of them takes one pass, so ``a_pass``, once the phrases of a pass, has no
    effect any more."""
    wanted = durable(_looked_up_by(lines, phrases, text))
    held = _met(lines, wanted, keys, text).join(wanted.select(_key(F.col("kind"), F.col("token")).alias("__key"), "phrase"), "__key")
    return held.where(F.contains(text, "phrase")).select(*keys, text, "phrase")


def leak_rules(lines: DataFrame, phrases: DataFrame, patterns=None, shown: int | None = 120) -> DataFrame:
    """What must not leave: ``(file, line_no, reason, fragment)`` per pattern or literal phrase. Fragments are cut to ``shown``
    characters; None keeps them whole."""
    patterns = V.LEAK_PATTERNS if patterns is None else patterns
    hits = []
    for reason, rx in patterns:
        hit = F.col("text").rlike(rx)
        if reason == "internal ticket":
            hit = hit & ~F.regexp_extract("text", rx, 0).rlike(V.NOT_A_TICKET)
        hits.append(F.when(hit, F.lit(reason)))
    reasons = F.filter(F.array(*hits), lambda r: r.isNotNull())
    fragment = (P.strip(F.col("text")) if shown is None else F.substring(P.strip(F.col("text")), 1, shown)).alias("fragment")
    by_rule = lines.select("file", "line_no", F.explode(reasons).alias("reason"), fragment)
    held = contains_phrase(lines, phrases, ["file", "line_no"])
    return by_rule.unionByName(held.select("file", "line_no", F.lit(V.PHRASE_REASON).alias("reason"), fragment))


def correlate(a: DataFrame, b: DataFrame, column: str, key_a: bytes, key_b: bytes, how: str = "inner") -> DataFrame:
    """Join two masked results on a pseudonym column; only sound under one key."""
    if key_a != key_b:
        raise ValueError("pseudonyms made with different keys cannot be compared")
    return a.join(b, column, how)
