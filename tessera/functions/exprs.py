"""Scalar helpers. All are compositions of built-in expressions, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"


def dec(column: str | Column, precision: int = 12, scale: int = 2) -> Column:
    """Fixed-point view of a column stored as double."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast(f"decimal({precision},{scale})")


def total(value: Column, scale: int) -> Column:
    """SUM with a pinned result type: decimal(38, scale)."""
    return F.sum(value).cast(f"decimal(38,{scale})")


def disc_price(price: Column, discount: Column) -> Column:
    return price * (F.lit(1).cast(MONEY) - discount)


def charge(price: Column, discount: Column, tax: Column) -> Column:
    return disc_price(price, discount) * (F.lit(1).cast(MONEY) + tax)


def contains(column: Column, needle: str) -> Column:
    return column.contains(needle)


def contains2(column: Column, first: str, second: str) -> Column:
    """``first`` and, somewhere after it, ``second``."""
    escape = lambda s: s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.like(f"%{escape(first)}%{escape(second)}%")


def starts_with(column: Column, head: str) -> Column:
    return column.startswith(head)


def ends_with(column: Column, tail: str) -> Column:
    return column.endswith(tail)


def prefix(column: Column, n: int) -> Column:
    return F.substring(column, 1, n)


def extract_year(column: Column) -> Column:
    return F.year(column).cast("int")


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def int_mod(a: Column, b: Column | int) -> Column:
    """Remainder with the sign of the dividend."""
    return a % (b if isinstance(b, Column) else F.lit(b))


def trunc_scale(value: Column, scale: int) -> Column:
    """Drop the digits beyond ``scale``, toward zero (Spark's casts round instead)."""
    step = F.lit(10**scale)
    scaled = value * step
    return (F.when(value < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) / step).cast(f"decimal(18,{scale})")


def rescale(value: Column, by: int) -> Column:
    """Move a fixed-point value ``by`` digits: more digits keep the value, fewer truncate."""
    return value.cast(f"decimal(18,{2 + by})") if by >= 0 else trunc_scale(value, 2 + by)


def hash_key(*columns: Column) -> Column:
    """64-bit hash of a composite key; each column seeds the next."""
    return F.xxhash64(*columns)


def checksum(column: Column) -> Column:
    """CRC-32 of a text's UTF-8 bytes."""
    return F.crc32(column.cast("binary"))


def murmur(*columns: Column) -> Column:
    """32-bit Murmur3 of a composite key, the hash that shuffles deal by."""
    return F.hash(*columns)


def parse_date(text: Column) -> Column:
    """``year-month-day`` with any number of digits and blanks around it; raises on anything else."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d+-\d+-\d+$"), F.make_date(*(F.split_part(t, F.lit("-"), F.lit(k)).cast("int") for k in (1, 2, 3)))).otherwise(
        F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("invalid date format: "), text)).cast("date"))
    )


def print_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def parse_timestamp(text: Column) -> Column:
    """``date hour:minute:second`` with milliseconds behind a point if any; raises on anything else."""
    parts = F.regexp_extract_all(F.trim(text), F.lit(r"^(\d+)-(\d+)-(\d+) (\d+):(\d+):(\d*)(?:\.(\d*))?$"), F.lit(0))
    part = lambda k: F.regexp_extract(F.trim(text), r"^(\d+)-(\d+)-(\d+) (\d+):(\d+):(\d*)(?:\.(\d*))?$", k)
    number = lambda k: F.coalesce(F.nullif(part(k), F.lit("")).cast("int"), F.lit(0))
    seconds = (number(6) + number(7) / F.lit(1000)).cast("decimal(8,6)")
    made = F.make_timestamp_ntz(number(1), number(2), number(3), number(4), number(5), seconds)
    return F.when(F.size(parts) == 1, made).otherwise(F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("invalid timestamp format: "), text)).cast("timestamp_ntz")))


def print_timestamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSS")
