"""Scalar text functions for prediction cleaning and label normalisation.

All are native Column expressions (whole-stage codegen, no Python).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
CLASS_PREFIX = "Class name: "
OPTIONS_HEADER = "OPTIONS:"
DIGITS = "0123456789"
# The characters str.strip() and str.split() take for blanks.
BLANK = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Remove leading and trailing whitespace (not only spaces; Unicode's too)."""
    return F.regexp_replace(_c(col), f"^{BLANK}+|{BLANK}+\\z", "")


def normalize_label(col) -> Column:
    """lower + strip, the comparison form of labels and predictions."""
    return strip(F.lower(_c(col)))


def strip_class_prefix(col) -> Column:
    """Delete every occurrence of ``Class name: `` (case-sensitive)."""
    return F.replace(_c(col), F.lit(CLASS_PREFIX), F.lit(""))


def extract_class_name(col) -> Column:
    """Lower-case; if the text has a colon keep the second colon-separated
    piece (``a:b:c`` -> ``b``); strip.  Null -> empty string."""
    low = F.lower(_c(col))
    piece = F.when(F.instr(low, ":") > 0, F.split_part(low, F.lit(":"), F.lit(2))).otherwise(low)
    return F.coalesce(strip(piece), F.lit(""))


def clean_prediction(col) -> Column:
    """Delete all digits from a string prediction; null -> empty string.
    Integer inputs are rendered as their decimal text first."""
    return F.coalesce(F.translate(_c(col).cast("string"), DIGITS, ""), F.lit(""))


def option_texts(options) -> Column:
    """Option texts of a numbered option block: drop ``OPTIONS:``, strip, split
    on newlines, keep lines that contain a dot, take the text after the first
    dot, strip and lower-case."""
    body = strip(F.replace(_c(options), F.lit(OPTIONS_HEADER), F.lit("")))
    lines = F.split(body, "\n")
    with_dot = F.filter(lines, lambda ln: F.instr(ln, ".") > 0)
    return F.transform(with_dot, lambda ln: strip(F.lower(F.substring(ln, F.instr(ln, ".") + 1, 1 << 30))))


def is_label_in_options(options, prediction) -> Column:
    """True when the (already normalised) prediction equals one option text."""
    return F.array_contains(option_texts(options), _c(prediction))


def parse_json_field(col, field: str = "class_name") -> Column:
    """Value of a top-level JSON field; null when the text is not one whole JSON
    document or the field is missing (never evaluates the text).

    JSON parsers accept text behind a document; wrapped as an array element and
    as a member's value, a document with such a tail fails at least once."""
    c = _c(col)
    whole = (F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull()
             & F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}"))).isNotNull())
    return F.when(whole, F.get_json_object(c, f"$.{field}"))


def whitespace_tokens(col) -> Column:
    """Non-empty whitespace-separated tokens."""
    return F.filter(F.split(_c(col), f"{BLANK}+"), lambda t: t != F.lit(""))


def string_array_literal(values) -> Column:
    """A constant ``array<string>`` from a Python list in one expression: one
    JSON literal that the optimizer folds into an array literal (thousands of
    separate ``lit`` calls would each cost a round trip to the JVM)."""
    import json

    from pyspark.sql import types as T

    return F.from_json(F.lit(json.dumps(list(values))), T.ArrayType(T.StringType()))
