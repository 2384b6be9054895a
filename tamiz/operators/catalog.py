"""Schema catalog: drift, change plans, merging, coverage, relations, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V
from tamiz.functions.personal import as_text
from tamiz.functions import sqltext as S
from tamiz.functions.types import normalise_type, same_type
from tamiz.operators.ordered import first_rows
from tamiz.session import local_rows

_KEY = ["table", "column"]


def _upper(df: DataFrame) -> DataFrame:
    return df.withColumn("table", F.upper("table")).withColumn("column", F.upper("column"))


def _sides(db: DataFrame, model: DataFrame) -> DataFrame:
    """Both sides column by column: types, nullability and which side has the table."""
    a = _upper(db).select(*_KEY, F.col("type").alias("db_type"), F.col("nullable").alias("db_nullable"),
                          F.lit(True).alias("in_db"))
    b = _upper(model).select(*_KEY, F.col("type").alias("model_type"),
                             F.coalesce("nullable", F.lit(True)).alias("model_nullable"), F.lit(True).alias("in_model"))
    tables = (a.select("table", "in_db").distinct().withColumnRenamed("in_db", "table_in_db")
              .join(b.select("table", "in_model").distinct().withColumnRenamed("in_model", "table_in_model"),
                    "table", "full_outer"))
    return a.join(b, _KEY, "full_outer").join(tables, "table")


def schema_drift(db: DataFrame, model: DataFrame, tables: list[str] | None = None, loose: bool = False) -> DataFrame:
    """One row per difference between the database and the model.

    ``change``: table only in database, table only in model, column only in database, column only in
    model, modified. A blank model type is not compared; ``loose`` equates NUMBER with NUMBER(38).
    """
    if tables is not None:
        names = [t.upper() for t in tables]
        db, model = (d.where(F.upper("table").isin(names)) for d in (db, model))
    both = _sides(db, model)
    equal = same_type(F.col("db_type"), F.col("model_type")) if loose else (
        normalise_type(F.col("db_type")) == normalise_type(F.col("model_type")))
    type_diff = ~equal & (normalise_type(F.col("model_type")) != "")
    null_diff = F.col("db_nullable") != F.col("model_nullable")
    shared = F.col("in_db") & F.col("in_model")
    change = (F.when(F.col("table_in_model").isNull(), "table only in database")
              .when(F.col("table_in_db").isNull(), "table only in model")
              .when(F.col("in_model").isNull(), "column only in database")
              .when(F.col("in_db").isNull(), "column only in model")
              .when(shared & (type_diff | F.coalesce(null_diff, F.lit(False))), "modified"))
    out = both.withColumn("change", change).where("change IS NOT NULL")
    modified = F.col("change") == "modified"
    whole = F.col("change").startswith("table")
    return out.select(
        "table", F.when(~whole, F.col("column")).alias("column"), "change",
        F.when(modified & type_diff, F.col("db_type")).alias("db_type"),
        F.when(modified & type_diff, F.col("model_type")).alias("model_type"),
        F.when(modified & null_diff, F.col("db_nullable")).alias("db_nullable"),
        F.when(modified & null_diff, F.col("model_nullable")).alias("model_nullable")).distinct()


def drift_labels(db: DataFrame, model: DataFrame, orphans: DataFrame | None = None,
                 system: str = r"^(SYS_|BIN\$|DR\$)") -> DataFrame:
    """Differences as labels, one per row; system tables left out, NUMBER equal to NUMBER(38)."""
    drift = schema_drift(db, model, loose=True).where(~F.col("table").rlike(system))
    if orphans is not None:
        marked = orphans.select(F.upper("table").alias("table")).distinct().withColumn("was_orphan", F.lit(True))
        drift = drift.join(marked, "table", "left")
    else:
        drift = drift.withColumn("was_orphan", F.lit(None).cast("boolean"))
    c = F.col("change")
    labels = F.array(
        F.when((c == "table only in database") & F.col("was_orphan").isNull(), F.lit("NEW_TABLE")),
        F.when((c == "table only in database") & F.col("was_orphan"), F.lit("ORPHAN_RECOVERED")),
        F.when(c == "table only in model", F.lit("MISSING")),
        F.when(c == "column only in database", F.lit("NEW_COL")),
        F.when(c == "column only in model", F.lit("REMOVED_COL")),
        F.when((c == "modified") & F.col("model_type").isNotNull(), F.lit("TYPE_DIFF")),
        F.when((c == "modified") & F.col("model_nullable").isNotNull(), F.lit("NULLABLE_DIFF")))
    return drift.select("table", "column", F.explode(F.filter(labels, lambda x: x.isNotNull())).alias("label"))


def _loaded(df: DataFrame, side: str) -> DataFrame:
    """The input, failing at run time when it is empty: an unread side is not a deleted one."""
    n = df.limit(1).count()
    if n == 0:
        raise ValueError(f"side {side} has no columns: not loaded, so nothing is compared")
    return df


def compare_environments(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences of two environments, refusing when a side failed to load."""
    return schema_drift(_loaded(a, "a"), _loaded(b, "b"))


def compare_indexes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Indexes that exist on one side only or differ in columns or uniqueness."""
    side = lambda d, s: d.select(F.upper("table").alias("table"), F.upper("name").alias("name"),
                                 F.array_join("columns", ",").alias(f"columns_{s}"), F.col("unique").alias(f"unique_{s}"))
    both = side(a, "a").join(side(b, "b"), ["table", "name"], "full_outer")
    change = (F.when(F.col("columns_b").isNull(), "only in a").when(F.col("columns_a").isNull(), "only in b")
              .when((F.col("columns_a") != F.col("columns_b")) | ~F.col("unique_a").eqNullSafe(F.col("unique_b")), "different"))
    return both.withColumn("change", change).where("change IS NOT NULL").select("table", "name", "change")


def change_plan(drift: DataFrame, relations: DataFrame, indexes: DataFrame) -> DataFrame:
    """Changes that bring the database to the model, as rows; dropping is only ever a candidate."""
    c = F.col("change")
    none = F.lit(None).cast("string")
    nullable = lambda s: F.coalesce(F.col(f"{s}_nullable").cast("string"), F.lit(""))
    side = lambda s: F.when(c == "modified", F.concat_ws(" null=", F.col(f"{s}_type"), F.nullif(nullable(s), F.lit(""))))
    op = (F.when(c == "table only in model", "CREATE_TABLE").when(c == "column only in model", "ADD_COLUMN")
          .when(c == "modified", "MODIFY_COLUMN").when(c == "column only in database", "DROP_COLUMN_CANDIDATE"))
    base = drift.withColumn("operation", op).where("operation IS NOT NULL").select(
        "operation", "table", "column", side("db").alias("from"), side("model").alias("to"))
    created = base.where("operation = 'CREATE_TABLE'").select("table").distinct()
    fks = relations.join(created, F.upper("source_table") == created["table"], "left_semi").select(
        F.lit("ADD_FK").alias("operation"), F.upper("source_table").alias("table"), F.upper("source_column").alias("column"),
        none.alias("from"), F.concat_ws(".", F.upper("target_table"), F.upper("target_column")).alias("to"))
    idx = indexes.join(created, F.upper(indexes["table"]) == created["table"], "left_semi").select(
        F.lit("CREATE_INDEX").alias("operation"), F.upper("table").alias("table"), none.alias("column"),
        none.alias("from"), F.concat(F.upper("name"), F.lit("("), F.array_join("columns", ","), F.lit(")")).alias("to"))
    return base.unionByName(fks).unionByName(idx)


def model_deviation(drift: DataFrame, orphans: DataFrame | None = None, names: int = 10) -> DataFrame:
    """Per kind of difference its count and the first names."""
    if orphans is not None:
        gone = orphans.select(F.upper("table").alias("table")).distinct()
        missing = drift.where("change = 'table only in model'").join(gone, "table", "left_anti")
        drift = drift.where("change <> 'table only in model'").unionByName(missing)
    label = drift.select("change", F.concat_ws(".", "table", "column").alias("name")).distinct()
    first = first_rows(label, ["change"], ["name"], names).groupBy("change").agg(
        F.array_sort(F.collect_list("name")).alias("names"))
    return label.groupBy("change").agg(F.count("*").alias("count")).join(first, "change")


def assemble_tables(columns: DataFrame, constraints: DataFrame, checks: DataFrame, indexes: DataFrame) -> DataFrame:
    """Flat dictionary rows to one row per table: ordered columns, key, unique sets, checks, indexes.
    What is gathered per table is bounded by its own declaration."""
    ordered = lambda pos, *cols: F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), *cols))), lambda s: s.dropFields("p"))
    cols = columns.groupBy("table").agg(ordered("ord", F.col("column"), F.col("type")).alias("columns"))
    pk = constraints.where("kind = 'P'").groupBy("table").agg(
        F.transform(ordered("pos", F.col("column")), lambda s: s["column"]).alias("pk"), F.min("name").alias("pk_name"))
    uniques = (constraints.where("kind = 'U'").groupBy("table", "name")
               .agg(F.transform(ordered("pos", F.col("column")), lambda s: s["column"]).alias("cols"))
               .groupBy("table").agg(F.array_sort(F.collect_list(F.struct("name", "cols"))).alias("uniques")))
    check = (checks.where(~F.col("condition").rlike(r'(?i)^\s*"?\w+"?\s+IS\s+NOT\s+NULL\s*$'))
             .groupBy("table").agg(F.array_sort(F.collect_list(F.struct("name", "condition"))).alias("checks")))
    idx = (indexes.groupBy("table", "name").agg(
        F.max("unique").alias("unique"), ordered("pos", F.col("column"), F.col("direction")).alias("cols"))
        .groupBy("table").agg(F.array_sort(F.collect_list(F.struct("name", "unique", "cols"))).alias("indexes")))
    return cols.join(pk, "table", "left").join(uniques, "table", "left").join(check, "table", "left").join(idx, "table", "left")


def foreign_keys(constraints: DataFrame) -> DataFrame:
    """Foreign keys with their column pairs in order."""
    return constraints.where("kind = 'R'").groupBy("table", "name", "ref_table", "delete_rule").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "column", "ref_column"))),
                    lambda s: F.struct(s["column"].alias("column"), s["ref_column"].alias("ref_column"))).alias("pairs"))


def apply_exclusions(tables: DataFrame, rules: DataFrame) -> DataFrame:
    """Tables with ``excluded`` (exact names only) and its reason; suspicious names are only marked."""
    named = rules.select(F.upper("name").alias("__n"), F.coalesce("reason", F.lit("no reason given")).alias("reason"))
    return (tables.join(named.dropDuplicates(["__n"]), F.upper("table") == F.col("__n"), "left")
            .withColumn("excluded", F.col("__n").isNotNull())
            .withColumn("suspicious", ~F.col("excluded") & F.col("table").rlike(V.SUSPICIOUS_TABLE)).drop("__n"))


def dangling_foreign_keys(fks: DataFrame, kept: DataFrame) -> DataFrame:
    """Foreign keys of kept tables that point to a table left out: they block a delivery."""
    names = kept.select(F.upper("table").alias("__k")).distinct()
    own = fks.join(names, F.upper("table") == F.col("__k"), "left_semi")
    return own.join(names, F.upper("ref_table") == F.col("__k"), "left_anti")


def merge_schema(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh structure with the human fields of the old catalog; tables not seen are kept whole.
    Both hold ``table, column, type, nullable, pk_pos, description, pii, safe``."""
    seen = fresh.select("table").distinct().withColumn("__seen", F.lit(True))
    o = old.select(*_KEY, *[F.col(c).alias(f"o_{c}") for c in ("type", "nullable", "pk_pos", "description", "pii", "safe")],
                   F.lit(True).alias("o_in"))
    f = fresh.select(*_KEY, "type", "nullable", "pk_pos", F.lit(True).alias("f_in"))
    both = o.join(f, _KEY, "full_outer").join(seen, "table", "left")
    kept = both.where(F.col("f_in") | F.col("__seen").isNull())
    pick = lambda c: F.when(F.col("f_in"), F.col(c)).otherwise(F.col(f"o_{c}")).alias(c)
    return kept.select(*_KEY, pick("type"), pick("nullable"), pick("pk_pos"),
                       F.coalesce("o_description", F.lit("")).alias("description"),
                       F.col("o_pii").alias("pii"), F.col("o_safe").alias("safe"),
                       F.when(F.col("f_in"), "db").otherwise("kept").alias("source"))


def refresh_subset(old: DataFrame, fresh: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog where only the named tables are replaced, and the status of every name."""
    wanted = names.select(F.upper("table").alias("table")).distinct()
    got = fresh.join(wanted, "table", "left_semi")
    present = got.select("table").distinct()
    status = wanted.join(present.withColumn("__in", F.lit(True)), "table", "left").select(
        "table", F.when(F.col("__in"), "updated").otherwise("not_in_db").alias("status"))
    return old.join(present, "table", "left_anti").unionByName(got), status


def mark_visibility(tables: DataFrame, seen: DataFrame, today: str) -> DataFrame:
    """Tables seen lose the flag, tables not seen get it with the date; none is removed."""
    s = seen.select(F.upper("table").alias("__t")).distinct()
    return tables.join(s, F.upper("table") == F.col("__t"), "left").select(
        *[c for c in tables.columns if c not in ("visible", "visible_check")],
        F.when(F.col("__t").isNull(), F.lit(False)).alias("visible"),
        F.when(F.col("__t").isNull(), F.lit(today)).alias("visible_check"))


def coverage(real: DataFrame, captured: DataFrame, excluded: DataFrame) -> DataFrame:
    """Per captured section the gap to what the dictionary declares. Unknown reality has no gap."""
    out = captured.join(real, "section", "left").join(excluded, "section", "left")
    exc = F.coalesce("excluded", F.lit(0))
    gap = F.when(F.col("real").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("real") - F.col("captured") - exc))
    return out.select("section", "real", "captured", exc.alias("excluded"), F.coalesce("reason", F.lit("")).alias("reason"),
                      gap.cast("bigint").alias("gap"))


def coverage_note(cov: DataFrame, is_owner: bool) -> DataFrame:
    """One row: total gap, whether the view is partial and what that means."""
    gaps = F.coalesce(F.sum("gap"), F.lit(0))
    if is_owner:
        note = F.when(gaps > 0, "owner account: the gap is a filter, not a permission").otherwise("")
    else:
        note = F.when(gaps > 0, "not the owner: an object may exist without a grant; nothing was removed").otherwise(
            "not the owner, but the count matches the dictionary")
    return cov.agg(gaps.alias("gaps"), (gaps > 0).alias("partial"), note.alias("note"))


def merge_coverage(old: DataFrame, new: DataFrame, origin: str, when: str) -> DataFrame:
    """Latest row per section, with where and when it came from."""
    both = old.unionByName(new.withColumn("origin", F.lit(origin)).withColumn("date", F.lit(when)))
    rest = [c for c in both.columns if c not in ("section", "date")]
    best = both.groupBy("section").agg(F.max_by(F.struct("date", *rest), "date").alias("b"))
    return best.select("section", "b.*")


def merge_indexes(model: DataFrame, db: DataFrame) -> DataFrame:
    """Manual indexes stay, database ones are replaced for tables this read saw."""
    seen = db.select("table").distinct()
    manual = model.where("source = 'manual'")
    unseen = model.where("source <> 'manual'").join(seen, "table", "left_anti")
    return manual.unionByName(unseen).unionByName(db.withColumn("source", F.lit("db")).select(*model.columns))


RELATION_KEY = ["source_table", "source_column", "target_table", "target_column"]


def merge_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every manual relation stays; other keys take the newest row. ``seq`` orders the rows."""
    manual = old.where("source = 'manual'")
    rest = old.where("source <> 'manual'").withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    columns = [c for c in old.columns if c not in RELATION_KEY]
    free = rest.join(manual.select(*RELATION_KEY).distinct(), RELATION_KEY, "left_anti")
    newest = free.groupBy(*RELATION_KEY).agg(F.max_by(F.struct(*columns), F.struct("__age", "seq")).alias("b"))
    return manual.unionByName(newest.select(*RELATION_KEY, "b.*"))


_RELATION = rf"({S.NAME})(?:\s+(?:AS\s+)?({S.WORD}))?"
_SIDE = rf"({S.WORD})\s*\.\s*({S.WORD})"
ALIASED = rf"(?i)\b(?:FROM|JOIN)\s+{_RELATION}"
JOINED = rf"(?i)\bJOIN\s+{_RELATION}\s+ON\s+\(*\s*{_SIDE}\s*=\s*{_SIDE}"
EQUAL = rf"(?i){_SIDE}\s*=\s*{_SIDE}"
WHERE_BODY = "(?is)" + V.RELATION_WHERE
IN_SELECT = "(?i)" + V.RELATION_IN


def infer_relations(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """Relations a query log implies: join conditions (high), equalities in WHERE (medium) and
    IN-subqueries (low). ``(source_table, source_column, target_table, target_column, inferred_from,
    confidence)``, with how many statements show each."""
    col = F.col(sql)
    grab = lambda text, rx: F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    part = lambda text, rx, g: F.upper(F.regexp_extract(text, rx, g))
    named = F.transform(grab(col, ALIASED), lambda m: F.named_struct(
        F.lit("t"), S.base_name(F.regexp_extract(m, ALIASED, 1)), F.lit("a"), part(m, ALIASED, 2)))
    named = F.filter(named, lambda e: ~e["t"].isin(V.SQL_WORDS))
    pair = lambda a, t: F.named_struct(F.lit("a"), a, F.lit("t"), t)
    pairs = F.flatten(F.transform(named, lambda e: F.array(
        pair(F.when(e["a"] == "", e["t"]).otherwise(e["a"]), e["t"]), pair(e["t"], e["t"]))))
    body = F.regexp_extract(col, WHERE_BODY, 1)
    row = lambda a1, c1, a2, c2, kind, conf: F.named_struct(
        F.lit("a1"), a1, F.lit("c1"), c1, F.lit("a2"), a2, F.lit("c2"), c2, F.lit("kind"), F.lit(kind), F.lit("conf"), F.lit(conf))
    sides = lambda m, kind, conf: row(*[part(m, EQUAL, g) for g in (1, 2, 3, 4)], kind, conf)
    joins = F.transform(grab(col, JOINED), lambda m: sides(F.regexp_extract(m, r"(?is)\bON\s+(.*)", 1), "JoinClause", "high"))
    wheres = F.transform(grab(body, EQUAL), lambda m: sides(m, "WhereClause", "medium"))
    ins = F.transform(grab(col, IN_SELECT), lambda m: row(
        *[part(m, IN_SELECT, g) for g in (1, 2, 4, 3)], "InSubquery", "low"))
    # The alias list of a statement is small, so it is looked up inside the row, without a join;
    # the last mention of an alias wins.
    of = lambda a: F.element_at(F.filter("__pairs", lambda p: p["a"] == a), -1)["t"]
    rows = statements.select(pairs.alias("__pairs"), F.explode(F.concat(joins, wheres, ins)).alias("r"))
    rows = rows.where((F.size(F.filter("__pairs", lambda p: p["a"] == F.col("r.a1"))) > 0)
                      & (F.size(F.filter("__pairs", lambda p: p["a"] == F.col("r.a2"))) > 0))
    named_rows = rows.select(of(F.col("r.a1")).alias("source_table"), F.col("r.c1").alias("source_column"),
                             of(F.col("r.a2")).alias("target_table"), F.col("r.c2").alias("target_column"),
                             F.col("r.kind").alias("inferred_from"), F.col("r.conf").alias("confidence"))
    return (named_rows.where("source_table <> target_table")
            .groupBy(*named_rows.columns).agg(F.count("*").alias("statements")))


def pk_order(cols: DataFrame) -> DataFrame:
    """Key columns per table: by position when positions are given, in declaration order when
    positions and plain marks are mixed, which is flagged. ``true`` is not position one."""
    keyed = cols.where(F.coalesce(F.col("pk_flag"), F.lit(False)) | (F.coalesce(F.col("pk_pos"), F.lit(0)) > 0))
    per = keyed.groupBy("table").agg(
        F.collect_list(F.struct("ord", "pk_pos", "column")).alias("ks"),
        F.bool_or(F.coalesce(F.col("pk_pos"), F.lit(0)) > 0).alias("some"),
        F.bool_or(F.coalesce(F.col("pk_pos"), F.lit(0)) == 0).alias("plain"))
    by_pos = F.array_sort(F.transform("ks", lambda k: F.struct(k["pk_pos"], k["ord"], k["column"].alias("c"))))
    by_ord = F.array_sort(F.transform("ks", lambda k: F.struct(k["ord"].alias("o"), k["ord"].alias("p"), k["column"].alias("c"))))
    names = F.when(F.col("some") & ~F.col("plain"), F.transform(by_pos, lambda k: k["c"])).otherwise(
        F.transform(by_ord, lambda k: k["c"]))
    return per.select("table", names.alias("pk"), (F.col("some") & F.col("plain")).alias("ambiguous"))


def table_schema(cols: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns of the named tables, and the names not found."""
    wanted = names.select(F.upper("table").alias("__t")).distinct()
    found = cols.join(wanted, F.upper("table") == F.col("__t"), "left_semi")
    missing = wanted.join(cols.select(F.upper("table").alias("__t")).distinct(), "__t", "left_anti")
    return found, missing.withColumnRenamed("__t", "table")


def model_index(cols: DataFrame) -> DataFrame:
    """Column names per table; a table's own columns bound the list."""
    return cols.groupBy("table").agg(F.array_sort(F.collect_list("column")).alias("columns"))


def search_model(cols: DataFrame, keyword: str, most: int = 100) -> DataFrame:
    """Tables whose name, description or columns hold the word: ``cols`` holds ``table, column, type,
    description, table_description``. Cut after ``most`` tables by name; ``total`` tells how many."""
    has = lambda c: F.upper(F.coalesce(F.col(c), F.lit(""))).contains(keyword.upper())
    hit_col = has("column") | has("description")
    got = cols.groupBy("table").agg(
        F.bool_or(has("table")).alias("match_table_name"), F.bool_or(has("table_description")).alias("described"),
        F.count_if(hit_col).alias("matching_columns"))
    hits = got.where("match_table_name OR described OR matching_columns > 0").drop("described")
    total = hits.count()
    return (hits.orderBy("table").limit(most).withColumn("total", F.lit(total))
            .withColumn("truncated", F.lit(total > most)))


#: Cells that the statements of one table are spread over.
ADVICE_CELLS = 256


def access_advice(statements: DataFrame, layout: DataFrame, sizes: DataFrame, large: int, wide: int = 10) -> DataFrame:
    """Statements whose filters a table's layout does not support.

    ``statements(id, sql)``; ``layout(table, columns)`` lists the leading partition, cluster or index
    columns in order; ``sizes(table, rows, n_columns)``. Findings by table size.
    """
    sql = F.col("sql")
    cell = F.pmod(F.xxhash64("id"), F.lit(ADVICE_CELLS)).alias("cell")
    base = statements.select("id", "sql", cell, S.sql_predicates(sql).alias("filtered"), F.explode(S.sql_tables(sql)).alias("table"))
    # One table may be in most statements: its facts are laid out once for each of its cells, so that a join key is a cell of a table.
    facts = base.select("table", "cell").distinct().join(sizes, "table").join(layout, "table", "left")
    known = base.join(facts, ["table", "cell"])
    big = F.col("rows") >= large
    cols = F.coalesce(F.transform("columns", lambda c: F.upper(c)), F.array().cast("array<string>"))
    used = F.array_intersect(F.col("filtered"), cols)
    wrapped = sql.rlike(r"(?is)\bWHERE\b.*\b(UPPER|LOWER|TRUNC|SUBSTR|TRIM|CAST)\s*\([^)]*\)\s*(=|<|>|LIKE)") | sql.rlike(
        r"(?i)\bLIKE\s+'%")
    findings = F.array(
        F.when(big & (F.size("filtered") > 0) & (F.size(used) == 0), F.struct(F.lit("no supporting column").alias("f"), F.lit("high").alias("s"))),
        F.when(big & (F.size(used) > 0) & ~F.array_contains(F.col("filtered"), F.get(cols, F.lit(0))),
               F.struct(F.lit("leading column not used").alias("f"), F.lit("medium").alias("s"))),
        F.when(big & wrapped, F.struct(F.lit("filter on an expression").alias("f"), F.lit("medium").alias("s"))),
        F.when((F.col("n_columns") >= wide) & sql.rlike(r"(?i)\bSELECT\s+\*"), F.struct(F.lit("select all").alias("f"), F.lit("medium").alias("s"))),
        F.when(big & sql.rlike(r"(?i)\b(ORDER|GROUP)\s+BY\b") & (F.size(used) == 0), F.struct(F.lit("unsupported sort").alias("f"), F.lit("low").alias("s"))))
    return (known.select("id", "table", F.explode(F.filter(findings, lambda x: x.isNotNull())).alias("x"))
            .select("id", "table", F.col("x.f").alias("finding"), F.col("x.s").alias("severity")))


def truncation_risk(df: DataFrame, declared: dict[str, tuple]) -> DataFrame:
    """Longest text and NULLs of every column against its declaration ``{column: (length, nullable)}``, in one pass. A number
    is declared ``(precision, nullable, scale)``: its longest whole part and its decimals are held against those, and
    ``loses_digits`` tells that a value would be cut or rounded."""
    declared = {c: (*d, None) if len(d) == 2 else d for c, d in declared.items()}
    kinds = dict(df.dtypes)
    aggs = []
    for i, (c, (_, _, scale)) in enumerate(declared.items()):
        if scale is not None:
            text = F.regexp_replace(as_text(F.col(c), kinds[c]), "^-", "")
            aggs += [F.max(F.length(F.regexp_replace(F.substring_index(text, ".", 1), "^0+", ""))).alias(f"w{i}"),
                     F.max(F.when(text.contains("."), F.length(F.substring_index(text, ".", -1))).otherwise(0)).alias(f"d{i}")]
        aggs += [F.max(F.length(F.col(c).cast("string") if scale is None else as_text(F.col(c), kinds[c]))).alias(f"m{i}"), F.count_if(F.col(c).isNull()).alias(f"n{i}")]
    one = df.agg(*aggs)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").cast("bigint").alias("longest"), F.col(f"n{i}").alias("nulls"),
                      F.lit(size).cast("bigint").alias("declared"),
                      F.coalesce(F.col(f"m{i}") > F.lit(size), F.lit(False)).alias("too_long") if scale is None else F.lit(False).alias("too_long"),
                      (F.lit(False) if scale is None else F.coalesce((F.col(f"w{i}") > size - scale) | (F.col(f"d{i}") > scale), F.lit(False))).alias("loses_digits"),
                      ((F.col(f"n{i}") > 0) & F.lit(not nullable)).alias("null_in_required"))
             for i, (c, (size, nullable, scale)) in enumerate(declared.items())]
    return one.select(F.inline(F.array(*cells)))


def table_inventory(tables: dict[str, DataFrame | None], kinds: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``(table, type, objects, status)``: rows of every table in one union of aggregates; tables without a reader are unreadable.
    ``kinds`` gives a table's column of object types and its counts by type instead."""
    kinds = kinds or {}
    there = {n: df for n, df in tables.items() if df is not None}
    parts = []
    for name, df in there.items():
        if name in kinds:
            kind = F.coalesce(F.col(kinds[name][0]).cast("string"), F.lit(kinds[name][1]))
            parts.append(df.groupBy(kind.alias("type")).agg(F.count("*").alias("objects")).select(F.lit(name).alias("table"), "type", "objects", F.lit("data").alias("status")))
        else:
            rows = F.count("*")
            parts.append(df.agg(rows.alias("objects")).select(F.lit(name).alias("table"), F.lit("row").alias("type"), "objects",
                                                              F.when(F.col("objects") > 0, "data").otherwise("empty").alias("status")))
    gone = [(n, None, None, "unreadable") for n, df in tables.items() if df is None]
    spark = next(iter(there.values())).sparkSession if there else SparkSession.active()
    parts.append(local_rows(spark, gone, "table string, type string, objects long, status string"))
    return reduce(DataFrame.unionByName, parts)


def structure_vs_table(spec: DataFrame, table: DataFrame) -> DataFrame:
    """Changes a table needs for an input structure. ``spec(table, column, type, length, nullable, pk,
    input_only)`` against ``table(table, column, type, length, nullable, pk)``."""
    s = _upper(spec).where(~F.coalesce(F.col("input_only"), F.lit(False))).drop("input_only")
    t = _upper(table).select(*_KEY, F.col("length").alias("t_length"), F.col("nullable").alias("t_nullable"),
                             F.col("pk").alias("t_pk"), F.lit(True).alias("t_in"))
    both = s.join(t, _KEY, "left")
    here = F.col("t_in").isNotNull()
    changes = F.array(
        F.when(~here, F.struct(F.lit("ADD_COLUMN").alias("op"), F.col("type").alias("d"))),
        F.when(here & (F.col("length") > F.col("t_length")), F.struct(F.lit("WIDEN_COLUMN").alias("op"), F.col("length").cast("string").alias("d"))),
        F.when(here & (F.col("nullable") != F.col("t_nullable")), F.struct(F.lit("CHANGE_NULLABLE").alias("op"), F.col("nullable").cast("string").alias("d"))))
    rows = both.select(*_KEY, F.explode(F.filter(changes, lambda x: x.isNotNull())).alias("c")).select(
        *_KEY, F.col("c.op").alias("operation"), F.col("c.d").alias("detail"))
    key = lambda d, c: d.where(F.coalesce(F.col(c), F.lit(False))).groupBy("table").agg(
        F.array_join(F.array_sort(F.collect_list("column")), ",").alias(c))
    keys = key(s, "pk").join(key(_upper(table), "pk").withColumnRenamed("pk", "t_pk"), "table", "left")
    pk = keys.where(~F.col("pk").eqNullSafe(F.col("t_pk"))).select(
        "table", F.lit(None).cast("string").alias("column"),
        F.when(F.col("t_pk").isNull(), "ADD_PRIMARY_KEY").otherwise("REVIEW_PRIMARY_KEY").alias("operation"),
        F.col("pk").alias("detail"))
    return rows.unionByName(pk)
