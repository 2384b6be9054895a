"""Synthetic rows: repeatable values from hashes of the row number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V
from tamiz.operators.validate import Structure


@dataclass(frozen=True)
class SeedColumn:
    name: str
    type: str
    length: int | None = None
    nullable: bool = True
    unique: bool = False


def draw(col: Column, salt: str) -> Column:
    """A repeatable whole number for a row number and a column."""
    digest = F.md5(F.concat(F.lit(salt + ":"), col.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def _value(c: SeedColumn, n: Column) -> Column:
    number = draw(n, c.name)
    if c.type in ("int", "bigint", "decimal"):
        value = n if c.unique else number % 1000
    elif c.type == "date":
        value = F.date_add(F.lit("2020-01-01").cast("date"), (number % 1826).cast("int"))
    else:
        text = F.concat(F.lit(c.name.capitalize() + " "), n.cast("string"))
        # The end of a text carries the number that makes it unique, so the start is cut.
        value = F.substring(text, -c.length, c.length) if c.length else text
        value = F.when(F.length(text) <= c.length, text).otherwise(value) if c.length else value
    if c.nullable and not c.unique:
        value = F.when(number % 10 != 0, value)
    return value.alias(c.name)


def seed_table(spark: SparkSession, columns: list[SeedColumn], n: int, base: int = V.SEED_BASE) -> DataFrame:
    """n rows with keys counted from a high base; nullable columns hold some NULLs."""
    rows = spark.range(base, base + n).select(F.col("id").alias("__n"))
    return rows.select(*[_value(c, F.col("__n")) for c in columns])


def seed_like(df: DataFrame, key: str, columns: list[SeedColumn], base: int = V.SEED_BASE) -> DataFrame:
    """A synthetic row for every row of a table, numbered by its whole-number key, so a copy without real values keeps the
    table's size and the spread of its keys."""
    return df.select((F.col(key).cast("bigint") + base).alias("__n")).select(*[_value(c, F.col("__n")) for c in columns])


def seed_related(spark: SparkSession, tables: dict[str, tuple[list[SeedColumn], int]],
                 keys: dict[tuple[str, str], tuple[str, str]], base: int = V.SEED_BASE) -> dict[str, DataFrame]:
    """Tables with parents before children; ``keys`` maps ``(child, column)`` to ``(parent, column)``.
    A child key is a number in the parent's key range, so no join is needed to draw it."""
    done: dict[str, DataFrame] = {}
    waiting = dict(tables)
    while waiting:
        ready = [t for t in waiting if all(p in done or p == t for (c, _), (p, _) in keys.items() if c == t)]
        if not ready:
            raise ValueError(f"tables depend on each other: {sorted(waiting)}")
        for t in ready:
            columns, n = waiting.pop(t)
            rows = spark.range(base, base + n).select(F.col("id").alias("__n"))
            out = []
            for c in columns:
                parent = keys.get((t, c.name))
                if parent:
                    size = tables[parent[0]][1]
                    out.append((F.lit(base) + draw(F.col("__n"), f"{t}.{c.name}") % size).alias(c.name))
                else:
                    out.append(_value(c, F.col("__n")))
            done[t] = rows.select(*out)
    return done


def sample_input_file(rows: DataFrame, spec: Structure) -> DataFrame:
    """Lines of a test file for a structure: padded fields, or parted ones, after a header line."""
    if spec.file_type == "positional":
        cells = [F.lpad(F.col(f.name).cast("string"), f.longitud, "0") if f.tipo in ("integer", "decimal")
                 else F.rpad(F.coalesce(F.col(f.name).cast("string"), F.lit("")), f.longitud, " ") for f in spec.fields]
        line = F.concat(*cells)
    elif spec.text_qualifier:
        q = spec.text_qualifier
        line = F.concat_ws(spec.delimiter, *[F.concat(F.lit(q), F.replace(F.coalesce(F.col(f.name).cast("string"), F.lit("")), F.lit(q), F.lit(q + q)), F.lit(q))
                                             for f in spec.fields])
    else:
        line = F.concat_ws(spec.delimiter, *[F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in spec.fields])
    body = rows.select(line.alias("value"))
    if not spec.tiene_cabecera:
        return body
    head = rows.sparkSession.range(1).select(F.lit(spec.delimiter.join(f.name for f in spec.fields)).alias("value"))
    return head.unionByName(body)
