"""Grammar of numeric text, as regular expressions for the JVM engine.

Spark's own casts are both wider ('1d' is a double) and narrower ('1_000' is not a
number) than the number syntax the profiles and coercions follow, so text is gated by
these patterns first and only then cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.binding import bind

_DIGITS = r"[0-9](?:_?[0-9])*"
_PAD = r"[\s\x1c-\x1f\x85\p{Z}]*"
# The characters that count as white space around a value.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
INTEGER_TEXT = rf"^{_PAD}[+-]?{_DIGITS}{_PAD}$"
# The common spellings, which the engine's own cast reads as they are.
PLAIN_NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
FLOAT_TEXT = (
    rf"(?i)^{_PAD}[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    rf"|inf(?:inity)?|nan){_PAD}$"
)


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends, not only blanks."""
    return F.trim(text, F.lit(WHITE_SPACE))


def is_integer_text(text: Column) -> Column:
    return text.rlike(INTEGER_TEXT)


def is_float_text(text: Column) -> Column:
    return text.rlike(FLOAT_TEXT)


def _loose_float(plain: Column) -> Column:
    """Value of lower-case text without padding and underscores."""
    negative = plain.startswith("-")
    return (
        F.when(plain.contains("inf"), F.when(negative, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        .when(plain.contains("nan"), F.lit(float("nan")))
        .otherwise(plain.try_cast("double"))
    )


def float_from_text(text: Column) -> Column:
    """Double value of numeric text, null for anything outside the grammar."""
    loose = bind(F.lower(F.replace(strip(text), F.lit("_"), F.lit(""))), _loose_float)
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double")).when(is_float_text(text), loose)


def text_type(text: Column) -> Column:
    """'integer', 'float' or 'string' for one text value."""
    return (
        F.when(is_integer_text(text), F.lit("integer"))
        .when(is_float_text(text), F.lit("float"))
        .otherwise(F.lit("string"))
    )
