"""Text, numbers and codes as Columns. A column name may stand for a Column everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean no measurement, and hours by unit.
SENTINELS = ("NR", "NC", "NA", "N/A", "NONE", "NULL")
HOURS = {"h": 1.0, "hr": 1.0, "hrs": 1.0, "hour": 1.0, "hours": 1.0, "d": 24.0, "day": 24.0, "days": 24.0, "min": 1 / 60, "minute": 1 / 60, "minutes": 1 / 60}
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
# White space at the ends of texts (ASCII), and anywhere in codes (Unicode's).
SPACE = " \t\n\x0b\f\r"
ANY_SPACE = SPACE + "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without any white space at both ends."""
    return F.trim(as_column(c).cast("string"), F.lit(SPACE))


def filled(c: Column | str) -> Column:
    """Stripped; null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def number(c: Column | str) -> Column:
    """A double, null for text that isn't a decimal number (such as 1d, 1_000, nan, inf)."""
    text = strip(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def measured(c: Column | str) -> Column:
    """As number; the sentinels, in any case, are null too."""
    return F.when(~F.upper(strip(c)).isin(*SENTINELS), number(c))


def whole(c: Column | str) -> Column:
    """The measured number without its fraction."""
    return measured(c).try_cast("long")


def or_else(c: Column | str, other: Column | str, blank: object) -> Column:
    """The first, but the other where it is null or equals `blank` (0 or ''); sentinels and white space stay."""
    c = as_column(c)
    return F.when(c.isNotNull() & (c != F.lit(blank)), c).otherwise(as_column(other))


def code(c: Column | str) -> Column:
    """A code in capitals without white space, ~ before it and / or * behind it; null gives ''."""
    bare = F.translate(F.upper(F.coalesce(as_column(c).cast("string"), F.lit(""))), ANY_SPACE, "")
    return F.rtrim(F.ltrim(bare, F.lit("~")), F.lit("/*"))


def effect_level(c: Column | str) -> Column:
    """The x of an ECx or LCx code."""
    return F.nullif(F.regexp_extract(code(c), r"^(EC|LC)(\d+(\.\d+)?)$", 2), F.lit("")).try_cast("double")


def hours(value: Column | str, unit: Column | str) -> Column:
    """A duration in hours; null for an unknown unit."""
    table = F.create_map(*[F.lit(x) for pair in HOURS.items() for x in pair])
    return as_column(value) * F.try_element_at(table, F.lower(strip(unit)))


def category(c: Column | str) -> Column:
    return F.coalesce(filled(c), F.lit("<missing>"))


def token(c: Column | str) -> Column:
    return F.coalesce(filled(c), F.lit("<UNK>"))


def group_key(*columns: Column | str) -> Column:
    return F.concat_ws("||", *[category(c) for c in columns])


def hash_bin(text: Column | str, bins: int) -> Column:
    """The first 32 bits of the text's md5, modulo bins."""
    return F.conv(F.substring(F.md5(as_column(text).cast("binary")), 1, 8), 16, 10).cast("long") % bins


def huber(error: Column | str, delta: float = 1.0) -> Column:
    size = F.abs(as_column(error))
    return F.when(size <= delta, 0.5 * size * size).otherwise(delta * (size - 0.5 * delta))
