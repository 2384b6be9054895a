"""Column expressions for personal data: value shapes, pseudonyms, redaction."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V

# Whitespace as text tools see it: Unicode blanks plus the four separator controls.
BLANKS = r"(?U)[\s\x{1c}-\x{1f}]+"
BLANK_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")
_WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
# A word edge that does not depend on the JVM release's reading of \b.
EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
# These begin and end with word characters, so their edges are one-sided; the cheap look-ahead
# spares the look-behind at most places.
_START, _END = f"(?<!{_WORD})", f"(?!{_WORD})"
DNI_IN_TEXT = rf"(?=\d){_START}({V.TEXT_SHAPES['dni']}){_END}"
NIE_IN_TEXT = rf"(?=[XYZ]\d){_START}({V.TEXT_SHAPES['nie']}){_END}"
IBAN_IN_TEXT = rf"(?=[A-Z]{{2}}\d){_START}({V.TEXT_SHAPES['iban']}){_END}"
EMAIL_IN_TEXT = f"{EDGE}({V.TEXT_SHAPES['email']}){EDGE}"
# Parts of the forms without edges: a text that lacks them cannot hold the form.
_DNI_HINT, _NIE_HINT, _IBAN_HINT = r"\d{8}[A-Z]", r"[XYZ]\d{7}[A-Z]", r"[A-Z]{2}\d{2}[A-Z0-9]{10}"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANK_CHARS))


def squash(col: Column) -> Column:
    """Trim and collapse inner whitespace to single blanks."""
    return strip(F.regexp_replace(col, BLANKS, " "))


def as_text(col: Column, dtype: str = "string") -> Column:
    """Cell text used for shape tests, pseudonyms and masking. A number has one text whatever its type: no exponent and no
    trailing zero decimals, so 612345678 reads the same as BIGINT, DECIMAL(38,10) or DOUBLE, and no digit is rounded away."""
    text = col.cast("string")
    if dtype in ("double", "float"):
        plain = text.try_cast("decimal(38,18)")
        # Beyond that scale the shortest text that reads back as the same number stays.
        text = F.when(plain.cast("double") == col.cast("double"), plain.cast("string")).otherwise(text)
    elif not dtype.startswith("decimal"):
        return text
    return F.when(text.contains(".") & ~text.contains("E"), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def is_blank(col: Column) -> Column:
    return col.isNull() | (F.length(strip(col)) == 0)


def detect_form(col: Column) -> Column:
    """First value shape the trimmed text matches, strong shapes first; NULL when none."""
    return form_of(strip(col))


def form_of(text: Column) -> Column:
    """Value shape of a text already trimmed."""
    tests = [F.when(text.rlike("(?i)" + rx), F.lit(name)) for name, rx in V.STRONG_SHAPES.items() if name != "email"]
    tests += [F.when(text.rlike(rx), F.lit(name)) for name, rx in V.WEAK_SHAPES.items()]
    # Only an e-mail holds an at sign; the others have eight characters at least and digits.
    return (F.when(text.contains("@"), F.when(text.rlike(V.STRONG_SHAPES["email"]), F.lit("email")))
            .when((F.length(text) >= 8) & text.rlike("[0-9]{2}"), F.coalesce(*tests)))


def is_plain_number(col: Column) -> Column:
    """A quantity or a count; long whole numbers look like identifiers and are refused."""
    return col.rlike(V.PLAIN_NUMBER) & ~col.rlike(rf"^-?\d{{{V.IDENTIFIER_DIGITS},}}$")


def _pads(key: bytes) -> tuple[bytes, bytes]:
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256_hex(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 from built-in hashes. The pads are plan literals: keep plans private or set
    spark.sql.redaction.string.regex."""
    inner, outer = _pads(key)
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def pseudonym(col: Column, domain: str, key: bytes) -> Column:
    """Stable stand-in for a value: equal values of one domain give equal pseudonyms."""
    message = F.concat(F.lit(domain.upper() + "|"), squash(col))
    return F.concat(F.lit(V.PSEUDONYM_PREFIX),
                    F.substring(hmac_sha256_hex(message, key), 1, V.PSEUDONYM_HEX))


def control_letter_ok(col: Column) -> Column:
    """Check letter of a DNI (8 digits) or NIE (X/Y/Z and 7 digits); false for other shapes."""
    text = F.upper(col)
    number = F.concat(F.translate(F.substring(text, 1, 1), "XYZ", "012"), F.substring(text, 2, 7))
    place = (number.try_cast("int") % 23 + 1).cast("int")
    letter = F.lit(V.CONTROL_LETTERS).substr(place, F.lit(1))
    return (text.rlike(r"^(\d{8}|[XYZ]\d{7})[A-Z]$")
            & F.coalesce(letter == F.substring(text, 9, 1), F.lit(False)))


def valid_ids(col: Column, pattern: str) -> Column:
    """Distinct identity numbers in the text whose check letter is right."""
    found = F.regexp_extract_all(col, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.filter(found, control_letter_ok))


def _replace_ids(col: Column, pattern: str, hint: str) -> Column:
    replaced = F.aggregate(
        valid_ids(col, pattern), col,
        lambda acc, hit: F.regexp_replace(acc, F.concat(F.lit(EDGE), hit, F.lit(EDGE)),
                                          F.lit(V.SUPPRESSED)))
    return F.when(col.rlike(hint), replaced).otherwise(col)


def redact_text(col: Column) -> Column:
    """Replace identity numbers with a right check letter, then IBANs, then e-mails."""
    out = bind(_replace_ids(col, DNI_IN_TEXT, _DNI_HINT), lambda t: _replace_ids(t, NIE_IN_TEXT, _NIE_HINT))
    out = bind(out, lambda t: F.when(t.rlike(_IBAN_HINT), F.regexp_replace(t, IBAN_IN_TEXT, V.SUPPRESSED)).otherwise(t))
    return bind(out, lambda t: F.when(t.contains("@"), F.regexp_replace(t, EMAIL_IN_TEXT, V.SUPPRESSED)).otherwise(t))


def redact_literals(col: Column) -> Column:
    """Blank quoted SQL literals, then redact what is left."""
    return redact_text(F.regexp_replace(col, V.QUOTED_LITERAL, "'<val>'"))


def personal_counts(col: Column) -> dict[str, Column]:
    """Number of personal values in a text, per form."""
    ids = lambda rx: F.size(F.filter(F.regexp_extract_all(col, F.lit(rx), F.lit(1)), control_letter_ok))
    return {
        "dni": F.when(col.rlike(_DNI_HINT), ids(DNI_IN_TEXT)).otherwise(0),
        "nie": F.when(col.rlike(_NIE_HINT), ids(NIE_IN_TEXT)).otherwise(0),
        "iban": F.when(col.rlike(_IBAN_HINT), F.regexp_count(col, F.lit(IBAN_IN_TEXT))).otherwise(0),
        "email": F.when(col.contains("@"), F.regexp_count(col, F.lit(EMAIL_IN_TEXT))).otherwise(0),
    }


def name_regex(patterns: list[str]) -> str:
    """One regular expression for a list of column-name globs."""
    if not patterns:
        return r"(?!)"
    return "(?i)^(?:" + "|".join(_glob(p) for p in patterns) + ")$"


def _glob(pattern: str) -> str:
    out = []
    for ch in pattern:
        out.append(".*" if ch == "*" else "." if ch == "?" else re.escape(ch))
    return "".join(out)


def clip(col: Column, most: int) -> Column:
    """Control characters to blanks, trim, cut with an ellipsis."""
    text = strip(F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " "))
    return bind(text, lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t))
