"""Text to typed value; text that does not look like the type becomes NULL.

Engines disagree on what their own casts accept (exponents, partial dates,
fractions as integers), so each conversion first checks one pattern.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings; blanks may surround them. A time of day follows a blank or
# a T, and may lack its seconds. The first group is what gets converted.
INT_TEXT = r"^ *([+-]?[0-9]+) *\z"
DECIMAL_TEXT = r"^ *([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)) *\z"
TIMESTAMP_TEXT = (
    r"^ *([0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]+)?)?)?) *\z"
)


def _matched(text: Column, pattern: str) -> Column:
    # One reference to the text: checking and converting it in two expressions would
    # make Catalyst repeat whatever computes the text. No match gives '', which no
    # type accepts.
    return F.regexp_extract(text, pattern, 1)


def to_int(text: Column) -> Column:
    return _matched(text, INT_TEXT).try_cast("int")


def to_money(text: Column) -> Column:
    return _matched(text, DECIMAL_TEXT).try_cast("decimal(12,2)")


def to_timestamp(text: Column) -> Column:
    """Zone-less timestamp; a blank is NULL because it does not match."""
    return _matched(text, TIMESTAMP_TEXT).try_cast("timestamp_ntz")


def folded(text: Column) -> Column:
    """Form in which texts are compared: case and trailing blanks do not count."""
    return F.lower(F.rtrim(text))


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")
