"""SQL functions for SQL users. They are SQL-bodied, so the optimizer inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tamiz.functions import fixed_values as V


def _lit(rx: str) -> str:
    return "'" + rx.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions and give their names."""
    shapes = " ".join(
        f"WHEN trim(v) RLIKE {_lit(rx if n == 'email' else '(?i)' + rx)} THEN '{n}'"
        for n, rx in [*V.STRONG_SHAPES.items(), *V.WEAK_SHAPES.items()])
    normal = "m"
    for rx, mark in V.MESSAGE_MARKERS:
        normal = f"regexp_replace({normal}, {_lit(rx)}, {_lit(mark)})"
    body = "regexp_replace(regexp_replace(regexp_replace(coalesce(t, ''), '\\\\r\\\\n?', '\\n'), '[^\\\\S\\n]+(?=\\n|\\\\z)', ''), '^\\\\s+|\\\\s+\\\\z', '')"
    number = "concat(translate(substr(upper(v), 1, 1), 'XYZ', '012'), substr(upper(v), 2, 7))"
    functions = {
        "detect_form": ("v STRING", "STRING", f"CASE {shapes} END"),
        "is_plain_number": ("v STRING", "BOOLEAN", f"v RLIKE {_lit(V.PLAIN_NUMBER)} AND NOT (v RLIKE '^-?[0-9]+$' AND length(replace(v, '-', '')) >= {V.IDENTIFIER_DIGITS})"),
        "control_letter_ok": ("v STRING", "BOOLEAN", f"upper(v) RLIKE '^([0-9]{{8}}|[XYZ][0-9]{{7}})[A-Z]$' AND coalesce(substr('{V.CONTROL_LETTERS}', CAST(try_cast({number} AS INT) % 23 + 1 AS INT), 1) = substr(upper(v), 9, 1), false)"),
        "normalise_message": ("m STRING", "STRING", f"regexp_replace({normal}, '^\\\\s+|\\\\s+$', '')"),
        "error_signature": ("c STRING, f STRING, m STRING", "STRING", "substr(sha1(concat_ws('|', c, f, normalise_message(m))), 1, 8)"),
        "normalise_body": ("t STRING", "STRING", body),
        "body_signature": ("t STRING", "STRING", "substr(sha2(normalise_body(t), 256), 1, 16)"),
    }
    for name, (args, result, expr) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {expr}")
    return list(functions)
