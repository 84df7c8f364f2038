"""Dimension tables: formats, conversion contracts, declared checks, accepted metadata.

They have a few dozen rows, fixed here, so broadcasting them is bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Per format its kind, magic (hex), payload cap, largest record offset, rule for a change of
# size, kind of undo, kind of region. Null where a format has no such limit.
FORMATS = [
    ("IPS", "direct", "5041544348", 65535, 0xFFFFFF, "grow or marker", "none", "write"),
    ("IPS32", "direct", "4950533332", 65535, 0xFFFFFFFF, "grow", "none", "write"),
    ("EBP", "direct", "5041544348", 65535, 0xFFFFFF, "grow", "none", "write"),
    ("PPF1", "direct", "50504631", 255, 0x7FFFFFFF, "none", "none", "write"),
    ("PPF2", "direct", "50504632", 255, 0x7FFFFFFF, "grow", "none", "write"),
    ("PPF3", "direct", "50504633", 255, 0x7FFFFFFFFFFFFFFF, "none", "carried", "write"),
    ("PPF4", "direct", "50504634", 255, 0xFFFFFFFF, "grow", "none", "write"),
    ("NINJA1", "direct", "4E494E4A4131", None, 0x7FFFFFFFFFFFFFFF, "grow", "none", "write"),
    ("PMSR", "direct", "504D5352", 0x7FFFFFFF, 0x7FFFFFFF, "grow", "none", "write"),
    ("APS-N64", "direct", "4150533130", 255, 0x7FFFFFFF, "any", "none", "write"),
    ("BPS", "differential", "42505331", None, None, "any", "none", "copy"),
    ("UPS", "differential", "55505331", None, None, "any", "self-inverse", "xor"),
    ("DPS", "differential", None, None, 0xFFFFFFFF, "any", "none", "copy"),
    ("NINJA2", "differential", "4E494E4A4132", None, None, "any", "self-inverse", "xor"),
    ("APS-GBA", "differential", "41505331", 65536, 0xFFFFFFFF, "any", "none", "xor"),
    ("GDIFF", "differential", "D1FFD1FF", None, 0x7FFFFFFFFFFFFFFF, "any", "none", "copy"),
    ("BSDiff", "differential", "4253444946463430", None, 0x7FFFFFFFFFFFFFFF, "any", "none", "meta"),
    ("VCDIFF", "differential", "D6C3C4", None, 0x7FFFFFFFFFFFFFFF, "any", "none", "copy"),
    ("xdelta1", "differential", "2558445A", None, 0xFFFFFFFF, "any", "none", "copy"),
]

# What a conversion target needs and takes besides records.
CONTRACTS = [
    ("IPS", [], ["truncation"]),
    ("IPS32", [], []),
    ("EBP", [], ["description", "ebp_meta"]),
    ("PPF1", [], ["description"]),
    ("PPF2", ["validation", "source_size"], ["description", "diz"]),
    ("PPF3", [], ["description", "image_type", "diz", "undo", "validation"]),
    ("PPF4", [], []),
    ("NINJA1", [], ["source_crc32", "source_md5", "source_sha1", "rom_type"]),
    ("PMSR", [], []),
    ("APS-N64", ["destination_size"], ["description"]),
]

# Fields whose loss would change the output.
OUTPUT_FIELDS = ["truncation", "destination_size"]

# The checks that formats declare, by side, with their severity.
CHECKS = [
    ("PPF2", "source", "block", "advisory"),
    ("PPF2", "source", "size", "advisory"),
    ("PPF3", "source", "block", "advisory"),
    ("BPS", "source", "crc32", "fatal"),
    ("BPS", "source", "size", "advisory"),
    ("BPS", "target", "crc32", "fatal"),
    ("UPS", "source", "crc32", "fatal"),
    ("UPS", "source", "size", "advisory"),
    ("UPS", "target", "crc32", "fatal"),
    ("VCDIFF", "target", "adler32", "fatal"),
    ("APS-N64", "source", "bytes", "advisory"),
    ("APS-N64", "source", "byte order", "fatal"),
    ("NINJA1", "source", "crc32", "fatal"),
    ("NINJA1", "source", "md5", "fatal"),
    ("NINJA1", "source", "sha1", "fatal"),
    ("NINJA2", "source", "md5", "fatal"),
    ("NINJA2", "target", "md5", "fatal"),
    ("APS-GBA", "source", "crc16", "advisory"),
    ("APS-GBA", "source", "size", "advisory"),
    ("APS-GBA", "target", "crc16", "advisory"),
    ("DPS", "source", "size", "fatal"),
    ("xdelta1", "source", "md5", "fatal"),
    ("xdelta1", "source", "size", "fatal"),
    ("xdelta1", "target", "md5", "fatal"),
]

# The metadata that a format takes on creation.
METADATA = {
    "EBP": ["title", "author", "description"],
    "PPF1": ["description"],
    "APS-N64": ["description"],
    "PPF2": ["description", "diz"],
    "PPF3": ["description", "image-type", "diz", "no-undo", "omit-verification"],
    "NINJA1": ["rom-type"],
    "BPS": ["metadata"],
    "DPS": ["title", "author", "patch-version", "unstable"],
    "NINJA2": ["title", "author", "patch-version", "description", "genre", "language", "date", "website", "rom-type", "ninja2-text-mode"],
    "xdelta1": ["omit-verification", "no-compress", "from-name", "to-name"],
    "VCDIFF": ["omit-verification", "no-compress", "compress-with", "metadata", "window-size"],
}

# Widths of console headers.
HEADER_WIDTHS = [16, 64, 128, 512]


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "format string, kind string, magic string, payload_cap long, max_offset long, size_rule string, undo string, region_kind string")


def contracts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTRACTS, "target string, required array<string>, accepted array<string>")


def checks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHECKS, "format string, side string, kind string, severity string")


def metadata(spark: SparkSession) -> DataFrame:
    names = [f[0] for f in FORMATS]
    return spark.createDataFrame([(f, METADATA.get(f, [])) for f in names], "format string, accepts array<string>")


def header_widths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in HEADER_WIDTHS], "width long")


def magics(spark: SparkSession) -> DataFrame:
    """Formats that are known by their first bytes; the longest that fits decides."""
    some = formats(spark).filter("magic IS NOT NULL AND format <> 'EBP'")
    return some.select("format", F.unhex("magic").alias("magic"), (F.length("magic") / 2).cast("int").alias("width"))
