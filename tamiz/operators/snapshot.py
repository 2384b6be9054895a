"""Object snapshots: inventory with body signatures, differences, delivery routes, file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions import bodies as B
from tamiz.functions import fixed_values as V
from tamiz.functions.personal import EDGE

_WORDS = r"[^\p{L}\p{Mn}\p{Nd}\p{Pc}]+"
_OBJECT = ["section", "name"]


def used_tables(objects: DataFrame, tables: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Tables a text names as whole words, any case: ``(keys, table)``, one row per pair.

    The words of a text meet the table names in a hash join. A name with other characters is found
    by its longest word and then looked for as written.
    """
    words = F.filter(F.split("__n", _WORDS), lambda w: w != "")
    names = tables.select(F.upper("table").alias("__n")).distinct().select(
        "__n", F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"].alias("__w"))
    tokens = objects.select(*keys, F.explode(F.array_distinct(F.split(F.upper(body), _WORDS))).alias("__w"))
    found = tokens.join(names, "__w").select(*keys, F.col("__n").alias("table"), (F.col("__n") == F.col("__w")).alias("__whole"))
    plain = found.where("__whole").select(*keys, "table")
    spelled = found.where("NOT __whole").select(*keys, "table").join(objects.select(*keys, F.upper(body).alias("__b")), keys)
    quoted = F.concat(F.lit(EDGE + "\\Q"), "table", F.lit("\\E" + EDGE))
    return plain.unionByName(spelled.where(F.regexp_like("__b", quoted)).select(*keys, "table"))


def build_inventory(objects: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Cards of ``(section, name, body, disabled)``: state, signature, lines, used tables.

    The head and the body of a package become one card; at most those two texts meet in a group.
    """
    section = B.section_of(F.col("name"), F.col("section"))
    parts = objects.select(
        section.alias("section"), F.when(F.col("section") == "procedimientos", B.clean_name(F.col("name")))
        .otherwise(F.col("name")).alias("name"),
        F.when(F.upper(F.trim("name")).startswith("PACKAGE BODY "), 1).otherwise(0).alias("place"),
        "body", F.coalesce("disabled", F.lit(False)).alias("disabled"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "norm"))), lambda p: p["norm"]), "\n")
    packages = (parts.where("section = 'paquetes'").withColumn("norm", B.normalise_body(F.col("body")))
                .groupBy(*_OBJECT).agg(F.bool_or("disabled").alias("disabled"), joined.alias("body"),
                                       F.sum(B.lines_in(F.col("norm"))).cast("bigint").alias("line_count"))
                .withColumn("signature", B.body_signature(F.col("body"))))
    # The normal form is staged, so that signature and line count share it.
    plain = parts.where("section <> 'paquetes'").withColumn("norm", B.normalise_body(F.col("body")))
    signed = F.when(F.col("section") == "secuencias", B.body_signature(F.col("body"), F.col("section"))).otherwise(
        F.substring(F.sha2("norm", 256), 1, 16))
    single = plain.select(*_OBJECT, "disabled", "body", B.lines_in(F.col("norm")).cast("bigint").alias("line_count"),
                          signed.alias("signature"))
    whole = single.unionByName(packages)
    cards = whole.select(*_OBJECT, F.when(F.col("disabled"), "DISABLED").otherwise("VALID").alias("state"), "signature", "line_count")
    if tables is None:
        return cards.withColumn("used_tables", F.array().cast("array<string>"))
    uses = used_tables(whole, tables, _OBJECT).groupBy(*_OBJECT).agg(F.array_sort(F.collect_set("table")).alias("used_tables"))
    return cards.join(uses, _OBJECT, "left").withColumn(
        "used_tables", F.coalesce("used_tables", F.array().cast("array<string>")))


def diff_inventory(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two inventories: new, removed, modified or state changed."""
    side = lambda d, p: d.select(*_OBJECT, F.col("signature").alias(f"{p}_signature"), F.col("state").alias(f"{p}_state"))
    both = side(old, "old").join(side(new, "new"), _OBJECT, "full_outer")
    change = (F.when(F.col("old_signature").isNull(), "new").when(F.col("new_signature").isNull(), "removed")
              .when(F.col("old_signature") != F.col("new_signature"), "modified")
              .when(F.col("old_state") != F.col("new_state"), "state changed"))
    return both.withColumn("change", change).where("change IS NOT NULL").select(*_OBJECT, "change")


def plan_delivery(diff: DataFrame) -> DataFrame:
    """Route of every change. A changed sequence is held: re-creating it would restart its counter;
    a removed object is only written as a comment."""
    held = (F.col("section") == "secuencias") & F.col("change").isin("modified", "state changed")
    route = F.when(F.col("change") == "removed", "comment").when(held, "hold").otherwise("deliver")
    return diff.withColumn("route", route)


def _failed(errors: DataFrame) -> DataFrame:
    """Failed sections; procedures and packages are read together, so they fail together."""
    both = F.when(F.col("section") == "procedimientos", F.array(F.lit("procedimientos"), F.lit("paquetes"))).otherwise(F.array("section"))
    return errors.select(F.explode(both).alias("section")).distinct()


def drop_failed_sections(diff: DataFrame, errors: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Changes of sections whose read worked; an incomplete coverage stops everything."""
    if gaps is not None and not gaps.where("gap > 0").isEmpty():
        raise ValueError("coverage is incomplete: a difference cannot be told from an unseen object")
    return diff.join(_failed(errors), "section", "left_anti")


def carry_failed_sections(old: DataFrame, new: DataFrame, errors: DataFrame) -> DataFrame:
    """New inventory with the previous cards of sections that could not be read, flagged."""
    failed = _failed(errors)
    kept = old.join(failed, "section", "left_semi").withColumn("carried", F.lit(True))
    return new.join(failed, "section", "left_anti").withColumn("carried", F.lit(False)).unionByName(kept)


def order_by_dependency(rows: DataFrame) -> DataFrame:
    """Rows in the order objects depend on each other, then by name, a package head first."""
    clean = F.regexp_replace("name", r"(?i)^PACKAGE\s+(BODY\s+)?", "")
    return rows.orderBy(B.section_rank(F.col("section")), clean, F.col("name").rlike(r"(?i)^PACKAGE\s+BODY\s"), "name")


def users_of(inventory: DataFrame, table: str) -> DataFrame:
    """Objects that use a table. Without any inventory it fails instead of answering none."""
    if inventory.isEmpty():
        raise ValueError("there is no inventory: the question cannot be answered")
    return inventory.where(F.array_contains("used_tables", table.upper())).select(*_OBJECT, "state")


def users_by_section(inventory: DataFrame) -> DataFrame:
    """How many objects of each section use every table."""
    return inventory.select("section", F.explode("used_tables").alias("table")).groupBy("table", "section").agg(
        F.count("*").alias("objects"))


def compare_trees(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths of ``(path, content)`` missing, extra or different after newline normalising."""
    digest = lambda d, n: d.select("path", F.sha2(F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n"), 256).alias(n))
    both = digest(a, "da").join(digest(b, "db"), "path", "full_outer")
    status = (F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra")
              .when(F.col("da") != F.col("db"), "different"))
    return both.withColumn("status", status).where("status IS NOT NULL").select("path", "status")


SECTIONS = V.SECTIONS
