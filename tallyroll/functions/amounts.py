"""Number parsing: one strict text-to-double rule and four dialects on top of it.

The dialects disagree on purpose (``1,346`` is 1346 for two of them and 1.346
for another), so each stage keeps its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python trims it, spelled out: Java's Unicode classes are slow.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Text that denotes a float: digits may be grouped with single underscores.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_FLOAT = (
    rf"[+-]?(?:(?:{_DIGITS})\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|[+-]?(?i:inf|infinity|nan)"
)
FLOAT_TEXT = rf"^[{SPACE}]*({_FLOAT})[{SPACE}]*$"
TRIMMED_FLOAT_TEXT = rf"^[{SPACE},.]*({_FLOAT})[{SPACE},.]*$"


def strip(text: Column) -> Column:
    """Trim every kind of white space on both ends, not only blanks."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def _first_float(text: Column, pattern: str) -> Column:
    return F.translate(F.regexp_extract(text, pattern, 1), "_", "").try_cast("double")


def strict_double(text: Column) -> Column:
    """Text to double; NULL unless the whole (trimmed) text is one float."""
    return _first_float(text, FLOAT_TEXT)


def _plain_double(text: Column) -> Column:
    """``strict_double`` of a text that holds only ASCII digits, dots and signs: there a cast follows the same rule."""
    return text.try_cast("double")


def metric_number(text: Column) -> Column:
    """Drop ``,`` ``$`` ``£`` anywhere, then a strict double."""
    return strict_double(F.translate(text, ",$£", ""))


# The parsers below run inside array lambdas, where nothing is shared between
# branches, so each step names its input once.


def locale_number(text: Column) -> Column:
    """The last separator is the decimal one; a lone comma groups thousands; bad text is 0.

    A leading run of ``R r p P`` and blanks is dropped, then separators and
    blanks at both ends.
    """
    body = F.regexp_extract(text, rf"(?s)^[{SPACE}]*[RrpP ]*(.*)$", 1)
    decimal_comma = text.contains(".") & F.substring_index(text, ".", -1).contains(",")
    plain = F.when(decimal_comma, F.translate(body, ",.", ".")).otherwise(
        F.translate(body, ",", "")
    )
    return F.coalesce(_first_float(plain, TRIMMED_FLOAT_TEXT), F.lit(0.0))


def cord_number(text: Column) -> Column:
    """Drop a currency prefix and commas, keep digits, dots and signs; bad text is NULL.

    Of the prefixes only ``Rp.`` holds a character that would otherwise stay.
    """
    return _plain_double(F.regexp_replace(text, rf"(?i)^[{SPACE}]*Rp\.|[^0-9.+-]+", ""))


def serving_number(text: Column) -> Column:
    """Signs are lost and the *first* comma against the first dot decides; bad text is 0."""
    kept = F.regexp_replace(text, r"[^0-9.,]+", "")
    comma, dot = F.instr(text, ","), F.instr(text, ".")
    plain = (
        F.when((comma > 0) & (dot > comma), F.translate(kept, ",", ""))
        .when(comma > 0, F.translate(kept, ",.", "."))
        .otherwise(kept)
    )
    return F.coalesce(_plain_double(plain), F.lit(0.0))


def zero_as_null(number: Column) -> Column:
    """A zero amount counts as absent."""
    return F.nullif(number, F.lit(0.0))


def corpus_quantity(text: Column) -> Column:
    """N5 for corpus rows: absent or empty is 1, unreadable is 0."""
    return F.when(text.isNull() | (text == ""), F.lit(1.0)).otherwise(locale_number(text))


def eval_quantity(text: Column) -> Column:
    """N5 for evaluated predictions: absent, empty or unreadable is 1."""
    return F.coalesce(strict_double(text), F.lit(1.0))


def serving_quantity(text: Column) -> Column:
    """N5 for served predictions: anything that reads as 0 is 1."""
    return F.coalesce(zero_as_null(serving_number(text)), F.lit(1.0))


def numeric_match(p: Column, g: Column, tolerance: float = 0.02) -> Column:
    """F6 on parsed amounts: within ``tolerance`` of the truth; a zero truth needs a zero."""
    return (
        F.when(p.isNull() | g.isNull(), F.lit(False))
        .when(g == 0, p == 0)
        .otherwise(F.abs(p - g) / F.abs(g) <= tolerance)
    )
