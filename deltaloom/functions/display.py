"""Rendering of numbers and bytes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_dump(data: Column, most: int = 64) -> Column:
    """The first bytes in hex, with dots if there are more (T4); a preview, so the limit is its purpose."""
    return F.concat(F.hex(F.substring(data, 1, most)), F.when(F.octet_length(data) > most, "...").otherwise(""))


def hex_offset(value: Column, width: int = 8) -> Column:
    """0x and at least ``width`` digits; the sign comes first."""
    digits = F.hex(F.abs(value))
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit("0x"), padded)


def grouped(value: Column) -> Column:
    """Thousands set off by commas."""
    return F.format_number(value, 0)


def plural(n: Column, noun: str) -> Column:
    return F.concat(grouped(n), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def prose(items: Column) -> Column:
    """a, b and c of an array."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(F.lit(0), n - 1)), ", ")
    return F.when(n == 0, "").when(n == 1, items[0]).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))


def printable(data: Column) -> Column:
    """Whether all bytes are printable ASCII."""
    return F.hex(data).rlike("^(2[0-9A-F]|[3-6][0-9A-F]|7[0-9A-E])*$")
