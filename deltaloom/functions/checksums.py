"""Checksums that Spark lacks, for single values and for columns of bytes."""

from __future__ import annotations

import binascii
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Polynomial and start of the 16-bit check (CCITT, reflected input is not used).
CRC16_POLY, CRC16_START = 0x1021, 0xFFFF


def crc16(data: bytes) -> int:
    return binascii.crc_hqx(data, CRC16_START)


def adler32(data: bytes) -> int:
    return zlib.adler32(data)


@F.pandas_udf(LongType())
def crc16_of(data: pd.Series) -> pd.Series:
    return data.map(crc16, na_action="ignore")


@F.pandas_udf(LongType())
def adler32_of(data: pd.Series) -> pd.Series:
    return data.map(adler32, na_action="ignore")


def digests(data: Column) -> list[Column]:
    """Size, CRC32, MD5 and SHA1 of a binary column (I4, G14); all inside the JVM."""
    return [
        F.octet_length(data).cast("long").alias("size"),
        F.lower(F.lpad(F.hex(F.crc32(data)), 8, "0")).alias("crc32"),
        F.md5(data).alias("md5"),
        F.sha1(data).alias("sha1"),
    ]


#: The sample that stands for a large image in its declared hashes.
SAMPLE_OVER, SAMPLE_HEAD, SAMPLE_TAIL = 0x1E00000, 20 << 20, 10 << 20


def hash_sample(data: Column, over: int = SAMPLE_OVER, head: int = SAMPLE_HEAD, tail: int = SAMPLE_TAIL) -> Column:
    """What declared hashes are taken of: the image, or of a large one its head, tail and size."""
    size = F.octet_length(data)
    part = F.concat(F.substring(data, 1, head), data.substr(size - tail + 1, F.lit(tail)), F.encode(size.cast("string"), "UTF-8"))
    return F.when(size > over, part).otherwise(data)
