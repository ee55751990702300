"""Text of seconds.  ``format_number`` rounds the exact binary value half to even, as decimal
formatting of doubles does elsewhere; ``round``, ``bround`` and ``format_string`` don't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """``value`` with ``digits`` decimals, without grouping."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def micro(value: Column) -> Column:
    """``value`` rounded to six decimals."""
    return fixed(value, 6).cast("double")


def for_path(value: Column) -> Column:
    """A number for file names: three decimals at most, no trailing zeros, ``_`` for the dot."""
    text = F.regexp_replace(fixed(value, 3), r"\.?0+$", "")
    return F.replace(text, F.lit("."), F.lit("_"))


def cell_label(frame_index: Column, seconds: Column) -> Column:
    return F.concat(F.lit("F"), frame_index, F.lit(" t="), fixed(seconds, 1), F.lit("s"))


def iso_utc(instant: Column) -> Column:
    """A UTC timestamp without zone as ISO text with its offset; the fraction, of six digits, only
    where there is one."""
    whole = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(instant, "SSSSSS")
    return F.concat(whole, F.when(part != "000000", F.concat(F.lit("."), part)).otherwise(""), F.lit("+00:00"))
