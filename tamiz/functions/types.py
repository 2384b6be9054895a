"""Column expressions over declared SQL types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V


def normalise_type(col: Column) -> Column:
    """Drop the CHAR/BYTE qualifier and blanks, upper case; NULL becomes empty."""
    bare = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?i)\s+(CHAR|BYTE)\s*\)", ")")
    return F.upper(F.regexp_replace(bare, r"\s+", ""))


def same_type(a: Column, b: Column) -> Column:
    """Equal after normalising; a bare NUMBER equals NUMBER(38)."""
    plain = lambda c: F.regexp_replace(normalise_type(c), r"^NUMBER\(38\)$", "NUMBER")
    return plain(a) == plain(b)


def build_type(name: Column, length: Column, precision: Column, scale: Column) -> Column:
    base = F.upper(F.trim(name))
    text = base.isin(V.TEXT_TYPES) & (length > 0)
    number = base.isin(["NUMBER", "DECIMAL", "NUMERIC", "FLOAT"]) & (precision > 0)
    return (F.when(text, F.concat(base, F.lit("("), length.cast("string"), F.lit(")")))
            .when(number & (scale > 0), F.concat(base, F.lit("("), precision.cast("string"), F.lit(","),
                                                scale.cast("string"), F.lit(")")))
            .when(number, F.concat(base, F.lit("("), precision.cast("string"), F.lit(")")))
            .otherwise(base))


def _size(col: Column) -> Column:
    """A size as text, NULL unless it is a positive whole number."""
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(r"^0*[1-9]\d*$"), text)


def render_type(name: Column, data_length: Column, char_length: Column, precision: Column,
                scale: Column, char_used: Column, dialect: str) -> Column:
    """Full type text of a dictionary row. A missing size never gives empty parentheses."""
    paren = lambda base, *parts: F.concat(base, F.lit("("), *parts, F.lit(")"))
    scale_text = F.trim(scale.cast("string"))
    if dialect == "ORACLE":
        base = F.upper(name)
        unit = F.when(char_used == "C", F.lit(" CHAR")).otherwise(F.lit(" BYTE"))
        count = F.when(char_used == "C", _size(char_length)).otherwise(_size(data_length))
        has_scale = scale_text.rlike(r"^\d+$") & (scale_text.try_cast("int") != 0)
        number = F.when(has_scale, paren(base, _size(precision), F.lit(","), scale_text)).otherwise(
            paren(base, _size(precision)))
        return (F.when(base.isin(V.TEXT_TYPES), F.coalesce(paren(base, count, unit), base))
                .when(base.isin("RAW", "UROWID"), F.coalesce(paren(base, _size(data_length)), base))
                .when(base == "NUMBER", F.coalesce(number, base))
                .when(base == "FLOAT", F.coalesce(paren(base, _size(precision)), base))
                .otherwise(base))
    base = F.lower(name)
    chars = F.when(base.isin("nvarchar", "nchar"),
                   F.floor(_size(data_length).try_cast("int") / 2).cast("string")).otherwise(_size(data_length))
    sized = F.when(F.trim(data_length.cast("string")) == "-1", paren(base, F.lit("MAX"))).otherwise(
        F.coalesce(paren(base, chars), base))
    return (F.when(base.isin("varchar", "nvarchar", "char", "nchar", "binary", "varbinary"), sized)
            .when(base.isin("decimal", "numeric"),
                  F.coalesce(paren(base, _size(precision), F.lit(","), scale_text), base))
            .when(base.isin("datetime2", "time", "datetimeoffset") & scale_text.rlike(r"^\d+$"),
                  paren(base, scale_text))
            .otherwise(base))


def map_type(col: Column, source: str, target: str) -> Column:
    """Type text in the other dialect: base looked up, size suffix kept."""
    if source == target:
        return col
    table = V.ORACLE_TO_SQLSERVER if source == "ORACLE" else V.SQLSERVER_TO_ORACLE
    base = F.upper(F.substring_index(col, "(", 1))
    suffix = col.substr(F.length(base) + 1, F.length(col))
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    mapped = F.concat(F.coalesce(F.try_element_at(lookup, base), base), suffix)
    if source == "ORACLE":
        return F.when((base == "NUMBER") & (suffix == ""), F.lit("DECIMAL(18,2)")).otherwise(mapped)
    return mapped


def missing_size(col: Column, dialect: str) -> Column:
    """'invalid' when the engine rejects the bare type, 'silent' when it means size one."""
    base = F.upper(F.regexp_extract(F.trim(col), r"^(\S+)", 1))
    bare = ~col.contains("(")
    rules = V.SIZE_REQUIRED[dialect]
    return (F.when(bare & base.isin(rules["invalid"]) if rules["invalid"] else F.lit(False), F.lit("invalid"))
            .when(bare & base.isin(rules["silent"]), F.lit("silent")))


def is_clear_type(col: Column) -> Column:
    text = F.upper(F.trim(F.coalesce(col, F.lit(""))))
    return text.rlike("^(" + "|".join(V.CLEAR_TYPE_PREFIXES) + ")")
