"""Texts in patches: named encodings, fixed widths, losses. Spark's own ``encode`` knows few encodings."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def encoding_name(alias: str) -> str:
    """The one name of an encoding, whatever alias it goes by; unknown ones are an error."""
    return codecs.lookup(alias.strip()).name


def decoded(raw: bytes, encoding: str = "utf-8") -> tuple[str, int]:
    """A text, and how many characters stand for bytes that could not be read."""
    text = raw.decode(encoding, "replace")
    return text, text.count("�") - (raw.count("�".encode()) if encoding_name(encoding) == "utf-8" else 0)


def fixed_field(raw: bytes, encoding: str = "utf-8") -> tuple[str | None, int]:
    """A field of fixed width: up to the first NUL, without blanks at its end; null if nothing is left."""
    text, lost = decoded(raw.split(b"\0", 1)[0], encoding)
    return text.rstrip() or None, lost


def bounded(text: str, width: int, encoding: str = "utf-8") -> tuple[bytes, bool]:
    """The bytes of a text that fit a width, cut between characters, and whether it was cut."""
    raw = text.encode(encoding, "replace")
    if len(raw) <= width:
        return raw, False
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        if len(text[:mid].encode(encoding, "replace")) <= width:
            low = mid
        else:
            high = mid - 1
    return text[:low].encode(encoding, "replace"), True


def fixed_field_of(raw: Column, encoding: str = "utf-8") -> Column:
    """struct<text, lost> of a binary column."""

    @F.pandas_udf(StructType([StructField("text", StringType()), StructField("lost", IntegerType())]))
    def f(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fixed_field(v, encoding) if v is not None else (None, None) for v in values], columns=["text", "lost"])

    return f(raw)
