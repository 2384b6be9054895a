"""Input files against declared structures. Findings are rows of one shape:
``(file, line_no, field, rule, value, message)``."""

from __future__ import annotations

from dataclasses import dataclass, fields as _fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V

FINDING = ["file", "line_no", "field", "rule", "value", "message"]
COMPARE = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
           "<": lambda a, b: a < b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


@dataclass(frozen=True)
class Field:
    """One declared field. ``tipo`` is text, integer, decimal or date. ``decimales`` is the most, or with
    ``decimales_obligatorios`` the exact, number of decimals; ``precision`` the most digits in all, leading zeros left out."""

    name: str
    tipo: str = "text"
    longitud: int | None = None
    start: int | None = None
    decimales: int | None = None
    decimales_obligatorios: bool = False
    precision: int | None = None
    nullable: bool = True
    pk: bool = False
    min: float | None = None
    max: float | None = None
    catalogo: tuple = ()
    domain: tuple = ()
    date_format: str | None = None
    numeric_format: str | None = None
    description: str = ""


@dataclass(frozen=True)
class Structure:
    """Contract of an input file. ``numeric_format`` names the decimal separator."""

    name: str
    file_type: str = "delimited"
    delimiter: str = ";"
    nomenclatura: str = ""
    date_format: str = "AAAAMMDD"
    numeric_format: str = "."
    fields: tuple[Field, ...] = ()
    comparisons: tuple[tuple[str, str, str], ...] = ()
    text_qualifier: str | None = None
    unique_combos: tuple[tuple[str, ...], ...] = ()
    tiene_cabecera: bool = False
    obligatoria: bool = False

    @staticmethod
    def load(document: dict) -> "Structure":
        """From a document. Unknown keys are an error: dropping them would lose a rule silently."""
        def checked(cls, d):
            unknown = set(d) - {f.name for f in _fields(cls)}
            if unknown:
                raise ValueError(f"{cls.__name__}: unknown keys {sorted(unknown)}")
            return d
        d = dict(checked(Structure, document))
        d["fields"] = tuple(Field(**{k: tuple(v) if isinstance(v, list) else v for k, v in checked(Field, f).items()})
                            for f in d.get("fields", ()))
        for key in ("comparisons", "unique_combos"):
            d[key] = tuple(tuple(x) for x in d.get(key, ()))
        return Structure(**d)


def typed(field: Field, spec: Structure) -> Column:
    """Field value in its type, NULL when it is empty or unreadable."""
    raw = F.nullif(F.trim(F.col(field.name)), F.lit(""))
    if field.tipo == "integer":
        return raw.try_cast("decimal(38,0)")
    if field.tipo == "decimal":
        if (field.numeric_format or spec.numeric_format) == ",":
            raw = F.replace(raw, F.lit(","), F.lit("."))
        return raw.try_cast("decimal(38,10)")
    if field.tipo == "date":
        return read_date(raw, field.date_format or spec.date_format)
    return raw


def read_date(col: Column, declared: str) -> Column:
    """Date text of a declared format; the digits must fill it exactly."""
    pattern = V.DATE_FORMATS[declared]
    shape = "".join(r"\d" if ch.isalpha() else ch for ch in pattern)
    return F.when(col.rlike(f"^{shape}$"), F.try_to_timestamp(col, F.lit(pattern)))


def numeric_ok(col: Column, decimals: int | None, separator: str, mandatory: bool = False, precision: int | None = None) -> Column:
    """Sign, digits, decimals and number of digits as declared."""
    point = "\\" + separator
    tail = ""
    if decimals:
        tail = rf"{point}\d{{{decimals}}}" if mandatory else rf"(?:{point}\d{{1,{decimals}}})?"
    shape = col.rlike(rf"^[-+]?\d+{tail}$")
    if precision is None:
        return shape
    return shape & (F.length(F.regexp_replace(F.regexp_replace(col, r"[^\d]", ""), "^0+(?=\\d)", "")) <= precision)


def _field_checks(field: Field, spec: Structure) -> list[tuple[str, Column, str]]:
    raw = F.col(field.name)
    text = F.trim(raw)
    empty = raw.isNull() | (text == "")
    out = []
    if not field.nullable:
        out.append(("required", empty, "value is required"))
    if field.longitud:
        out.append(("length", ~empty & (F.length(raw) > field.longitud), f"longer than {field.longitud}"))
    if field.tipo in ("integer", "decimal"):
        separator = field.numeric_format or spec.numeric_format
        ok = numeric_ok(text, field.decimales if field.tipo == "decimal" else None, separator, field.decimales_obligatorios, field.precision)
        out.append(("type" if field.tipo == "integer" else "numeric", ~empty & ~ok, f"not {field.tipo}"))
        value = typed(field, spec)
        if field.min is not None:
            out.append(("min", F.coalesce(value < field.min, F.lit(False)), f"below {field.min}"))
        if field.max is not None:
            out.append(("max", F.coalesce(value > field.max, F.lit(False)), f"above {field.max}"))
    if field.tipo == "date":
        declared = field.date_format or spec.date_format
        out.append(("date", ~empty & read_date(text, declared).isNull(), f"not a date {declared}"))
    allowed = [*field.domain, *field.catalogo]
    if allowed:
        out.append(("domain" if field.domain else "catalog", ~empty & ~text.isin([str(a) for a in allowed]),
                    "value not allowed"))
    return out


def check_rows(rows: DataFrame, spec: Structure) -> DataFrame:
    """All row rules in one projection: required, length, type, numbers, dates, domains, limits and
    comparisons between fields. No shuffle."""
    finding = lambda name, rule, value, text: F.struct(
        F.lit(name).alias("field"), F.lit(rule).alias("rule"), value.cast("string").alias("value"), F.lit(text).alias("message"))
    hits = [F.when(bad, finding(f.name, rule, F.col(f.name), text))
            for f in spec.fields for rule, bad, text in _field_checks(f, spec)]
    by_name = {f.name: f for f in spec.fields}
    for left, op, right in spec.comparisons:
        a, b = typed(by_name[left], spec), typed(by_name[right], spec)
        hits.append(F.when(~COMPARE[op](a, b), finding(left, "comparison", F.col(left), f"not {op} {right}")))
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return rows.select("file", "line_no", F.explode(found).alias("h")).select("file", "line_no", "h.*")


def _repeated(rows: DataFrame, columns: list[str], field: str, rule: str) -> DataFrame:
    """Rows after the first of each value combination of a file. Only one small row per repeated
    combination is kept as state; a hot key is joined back, where its large side can be split."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    keyed = rows.select("file", "line_no", *columns)
    firsts = (keyed.groupBy("file", *columns).agg(F.min("line_no").alias("first_line"), F.count("*").alias("n"))
              .where("n > 1").select(F.col("file").alias("__file"), *[F.col(c).alias(f"__{c}") for c in columns], "first_line"))
    cond = [F.col("file") == F.col("__file"), F.col("line_no") > F.col("first_line"),
            *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]]
    return keyed.join(firsts, cond).select(
        "file", "line_no", F.lit(field).alias("field"), F.lit(rule).alias("rule"), key.alias("value"),
        F.lit("repeated").alias("message"))


def check_pk(rows: DataFrame, columns: list[str]) -> DataFrame:
    return _repeated(rows, columns, ",".join(columns), "pk")


def check_unique_combos(rows: DataFrame, combos: list[list[str]]) -> DataFrame:
    out = None
    for combo in combos:
        part = _repeated(rows, list(combo), "UNIQUE", "unique:" + ",".join(combo))
        out = part if out is None else out.unionByName(part)
    return out


def check_catalog(rows: DataFrame, field: str, catalog: DataFrame, code: str = "code") -> DataFrame:
    """Values of a field missing from a catalog table."""
    text = F.trim(F.col(field).cast("string"))
    asked = rows.where(F.col(field).isNotNull() & (text != "")).withColumn("__v", text)
    known = catalog.select(F.col(code).cast("string").alias("__v")).distinct()
    return asked.join(known, "__v", "left_anti").select(
        "file", "line_no", F.lit(field).alias("field"), F.lit("catalog").alias("rule"),
        F.col(field).cast("string").alias("value"), F.lit("not in the catalog").alias("message"))


def check_relation(f1: DataFrame, f2: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Integrity both ways: rows of each side whose key the other side lacks."""
    def one_way(a, b, a_keys, b_keys, rule):
        other = b.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(b_keys)]).distinct()
        cond = [a[k] == other[f"__k{i}"] for i, k in enumerate(a_keys)]
        return a.join(other, cond, "left_anti").select(
            "file", "line_no", F.lit(",".join(a_keys)).alias("field"), F.lit(rule).alias("rule"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in a_keys]).alias("value"),
            F.lit("no matching row").alias("message"))
    left, right = [k for k, _ in keys], [k for _, k in keys]
    return one_way(f1, f2, left, right, "f1_not_in_f2").unionByName(one_way(f2, f1, right, left, "f2_not_in_f1"))


def check_structure(rows: DataFrame, spec: Structure) -> DataFrame:
    """Row rules, key and unique combinations of one structure."""
    out = check_rows(rows, spec)
    pk = [f.name for f in spec.fields if f.pk]
    if pk:
        out = out.unionByName(check_pk(rows, pk))
    if spec.unique_combos:
        out = out.unionByName(check_unique_combos(rows, [list(c) for c in spec.unique_combos]))
    return out


def match_files(files: DataFrame, structures: DataFrame) -> DataFrame:
    """Structure of every file by name pattern, the longest match winning, then the first name. Patterns are looked up by hash:
    the pieces of a file name, which is short, meet the registry ``(structure, pattern)`` in a join, however long that is."""
    known = (structures.select("structure", F.upper("pattern").alias("pattern")).where("pattern <> ''")
             .groupBy("pattern").agg(F.min("structure").alias("structure")))
    names = files.select(F.upper("file").alias("name")).where("name IS NOT NULL").distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1)))
    pieces = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("name") - i + 1, F.lit(1))), lambda n: F.substr("name", i, n)))))
    best = (names.select("name", F.explode(pieces).alias("pattern")).join(known, "pattern").groupBy("name")
            .agg(F.min_by("structure", F.struct(-F.length("pattern"), "structure")).alias("structure")))
    return files.select("file", F.upper("file").alias("name")).join(best, "name", "left").select("file", "structure")


def missing_files(matched: DataFrame, structures: DataFrame) -> DataFrame:
    """Required structures with no file."""
    have = matched.where("structure IS NOT NULL").select("structure").distinct()
    return structures.where("required").join(have, "structure", "left_anti").select("structure")


def unmatched_files(matched: DataFrame) -> DataFrame:
    return matched.where("structure IS NULL").select("file")


def validation_report(findings: DataFrame, rows: DataFrame, cap: int = 1000) -> DataFrame:
    """Errors per file, field and rule with subtotals per file and in all (NULL keys), and the rows
    of the file without any error."""
    counts = findings.rollup("file", "field", "rule").agg(
        F.count("*").alias("errors"), F.count_distinct("file", "line_no").alias("bad_rows"))
    totals = rows.groupBy("file").agg(F.count("*").alias("rows"))
    all_rows = rows.agg(F.count("*").alias("all_rows"))
    per_file = counts.join(totals, "file", "left")
    everything = all_rows.first()["all_rows"]
    size = F.coalesce("rows", F.lit(everything))
    return per_file.select("file", "field", "rule", "errors", (size - F.col("bad_rows")).alias("valid_rows"),
                           (F.col("errors") > cap).alias("over_cap"))


def detect_structure(sample: DataFrame, separators: tuple[str, ...] = (";", "|", ",", "\t")) -> DataFrame:
    """Separator and column types of a text sample ``(file, line_no, text)``: the separator that
    cuts every line of a file into the same number of parts, the most parts winning; a type holds
    when every non-blank value reads as it."""
    sizes = sample.select("file", *[F.size(F.split("text", "\\" + s if s != "\t" else "\t")).alias(f"n{i}")
                                    for i, s in enumerate(separators)])
    agg = sizes.groupBy("file").agg(*[F.struct(F.when(F.min(f"n{i}") == F.max(f"n{i}"), F.max(f"n{i}")).otherwise(0).alias("n"),
                                               F.lit(-i).alias("rank"), F.lit(s).alias("sep")).alias(f"s{i}")
                                      for i, s in enumerate(separators)])
    best = F.greatest(*[F.col(f"s{i}") for i in range(len(separators))])
    chosen = agg.select("file", best.alias("b")).select(
        "file", F.when(F.col("b.n") > 1, F.col("b.sep")).alias("separator"), F.col("b.n").alias("columns"))
    cells = sample.join(chosen.where("separator IS NOT NULL"), "file").select(
        "file", "separator", "columns",
        F.posexplode(F.split("text", F.concat(F.lit("\\Q"), "separator", F.lit("\\E")))).alias("position", "cell"))
    text = F.nullif(F.trim("cell"), F.lit(""))
    reads = {"integer": text.rlike(r"^[-+]?\d+$"), "decimal": text.rlike(r"^[-+]?\d+([.,]\d+)?$")}
    dates = {name: read_date(text, name).isNotNull() for name in V.DATE_FORMATS}
    share = lambda c: F.bool_and(F.when(text.isNotNull(), c))
    typed_cells = cells.groupBy("file", "separator", "columns", "position").agg(
        *[share(c).alias(n) for n, c in reads.items()], *[share(c).alias(n) for n, c in dates.items()])
    kind = F.coalesce(*[F.when(F.col(f"`{n}`"), F.lit("date " + n)) for n in dates],
                      F.when(F.col("integer"), F.lit("integer")), F.when(F.col("decimal"), F.lit("decimal")), F.lit("text"))
    return typed_cells.select("file", "separator", "columns", "position", kind.alias("type"))


def latest_version(versions: DataFrame) -> DataFrame:
    """Latest row per structure of ``(structure, version, body)``."""
    return versions.groupBy("structure").agg(F.max("version").alias("version"), F.max_by("body", "version").alias("body"))


def nth_version(versions: DataFrame, n: int) -> DataFrame:
    return versions.where(F.col("version") == n)


def restore_version(versions: DataFrame, n: int) -> DataFrame:
    """Every version plus version n appended as the newest of its structure."""
    newest = versions.groupBy("structure").agg((F.max("version") + 1).alias("next"))
    again = nth_version(versions, n).join(newest, "structure").select(
        "structure", F.col("next").alias("version"), "body")
    return versions.select("structure", "version", "body").unionByName(again)


def group_filter(structures: DataFrame, group: int | None) -> DataFrame:
    """Structures of a group; zero or none asks for the standard group, stored as NULL."""
    stored = F.nullif(F.col("group_id"), F.lit(0))
    return structures.where(stored.isNull() if not group else stored == group)


def expand_user_pairs(relations: DataFrame, files: DataFrame) -> DataFrame:
    """Files per using tenant: driven by the relation ``(user_tenant, file)``, never by owner."""
    return relations.select("user_tenant", "file").distinct().join(files, "file", "left")


def propagate_order(attributes: DataFrame, species: DataFrame) -> DataFrame:
    """Attributes take the process order of their species, keeping their own where it has none."""
    order = species.select("species", F.col("process_order").alias("__order"))
    return attributes.join(order, "species", "left").withColumn(
        "table_order", F.coalesce("__order", "table_order")).drop("__order")


def orphan_rows(attributes: DataFrame, files: DataFrame) -> DataFrame:
    """Attributes with a flag for those whose file is gone."""
    known = files.select("file").distinct().withColumn("__known", F.lit(True))
    return attributes.join(known, "file", "left").withColumn("orphan", F.col("__known").isNull()).drop("__known")


def orphan_references(tenants: DataFrame, algorithms: DataFrame) -> DataFrame:
    """Tenants that point to an algorithm code that no longer exists."""
    return tenants.where(F.col("code").isNotNull()).join(algorithms.select("code").distinct(), "code", "left_anti")
