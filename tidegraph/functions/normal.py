"""Normal forms of keys and the row conditions shared by all payment queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Unicode or Python counts as whitespace.
WHITESPACE_CODES = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE = "".join(map(chr, WHITESPACE_CODES))

# Words that stand for a missing value.
NO_VALUE_WORDS = ("", "<na>", "nan", "none", "null")

SECONDS_PER_DAY = 86_400


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Whitespace of any Unicode kind removed at both ends."""
    return F.btrim(as_column(c), F.lit(WHITESPACE))


def normal_form(c: Column | str) -> Column:
    """Trimmed and lower-cased; NULL for no value (null, empty or a word for missing)."""
    t = F.lower(trimmed(c))
    return F.when(~t.isin(*NO_VALUE_WORDS), t)


def clean_entity(c: Column | str) -> Column:
    """The graph's entity value: trimmed with its case kept; NULL for no value."""
    t = trimmed(c)
    return F.when(~F.lower(t).isin(*NO_VALUE_WORDS), t)


def timed(c: Column | str = "transaction_time") -> Column:
    """True where a time is present and not negative (false, not NULL, otherwise)."""
    return F.coalesce(as_column(c) >= 0, F.lit(False))


def paid(c: Column | str = "amount") -> Column:
    """True where an amount is present, a number and not negative."""
    a = as_column(c)
    return F.coalesce((a >= 0) & ~F.isnan(a), F.lit(False))


def day_number(c: Column | str = "transaction_time") -> Column:
    """Whole days since time zero; NULL stays NULL."""
    return F.floor(as_column(c) / F.lit(SECONDS_PER_DAY)).cast("bigint")


def cents(c: Column | str = "amount") -> Column:
    """An amount of two decimals as whole cents, so that sums and comparisons are exact."""
    return F.round(as_column(c).cast("double") * F.lit(100.0)).cast("decimal(38,0)").cast("bigint")
