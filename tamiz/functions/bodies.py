"""Column expressions over object bodies: normal form, signature, section."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V
from tamiz.functions.personal import BLANK_CHARS, bind, strip


def normalise_body(col: Column) -> Column:
    """Newlines to LF, lines cut on the right, ends trimmed; indentation stays."""
    lines = F.split(F.coalesce(col, F.lit("")), r"\r\n|\r|\n")
    return strip(F.array_join(F.transform(lines, lambda l: F.rtrim(l, F.lit(BLANK_CHARS))), "\n"))


def body_signature(col: Column, section: Column | None = None) -> Column:
    """Sixteen hexadecimal digits of the normal form; a sequence's position does not count."""
    text = col
    if section is not None:
        text = F.when(section == "secuencias",
                      F.regexp_replace(col, V.SEQUENCE_POSITION, V.SEQUENCE_MARKER)).otherwise(col)
    return F.substring(F.sha2(normalise_body(text), 256), 1, 16)


def line_count(col: Column) -> Column:
    return lines_in(normalise_body(col))


def lines_in(body: Column) -> Column:
    """Lines of a text already in normal form."""
    return bind(body, lambda b: F.when(b == "", 0).otherwise(F.size(F.split(b, "\n"))))


def clean_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"(?i)^(PACKAGE BODY|PACKAGE|PROCEDURE|FUNCTION|TYPE BODY|TYPE)\s+", "")


def section_of(name: Column, section: Column) -> Column:
    """Section after reading the kind written in front of a procedure name."""
    head = F.upper(F.trim(name))
    return (F.when(section != "procedimientos", section)
            .when(head.startswith("PACKAGE "), "paquetes")
            .when(head.startswith("FUNCTION "), "funciones")
            .otherwise(section))


def section_rank(section: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in V.SECTIONS]), section)
