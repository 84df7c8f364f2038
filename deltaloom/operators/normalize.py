"""Bringing console images into the form that patches are made for, and back (V8).

A shape is recognised by its first bytes or its size; what is taken off is kept, so that :func:`restore` gives
the image's own bytes back. Images that no rule knows stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Header widths and first bytes by platform.
INES, LYNX, COPIER = 16, 64, 512
N64_ORDERS = {b"\x80\x37\x12\x40": "z64", b"\x37\x80\x40\x12": "v64", b"\x40\x12\x37\x80": "n64"}
SMD_BLOCK = 16384


@dataclass
class Normal:
    data: bytes
    shape: str = "as is"
    header: bytes = b""


def swapped(data: bytes, width: int) -> bytes:
    """Every ``width`` bytes reversed; an incomplete last word stays."""
    n = len(data) // width * width
    return np.frombuffer(data[:n], np.uint8).reshape(-1, width)[:, ::-1].tobytes() + data[n:]


def deinterleaved(data: bytes) -> bytes:
    """Blocks whose first half holds the odd bytes and whose second half the even ones."""
    n = len(data) // SMD_BLOCK * SMD_BLOCK
    blocks = np.frombuffer(data[:n], np.uint8).reshape(-1, 2, SMD_BLOCK // 2)
    return np.stack([blocks[:, 1], blocks[:, 0]], axis=2).tobytes() + data[n:]


def interleaved(data: bytes) -> bytes:
    n = len(data) // SMD_BLOCK * SMD_BLOCK
    pairs = np.frombuffer(data[:n], np.uint8).reshape(-1, SMD_BLOCK // 2, 2)
    return np.stack([pairs[:, :, 1], pairs[:, :, 0]], axis=1).tobytes() + data[n:]


def normalize(data: bytes, platform: str) -> Normal:
    size = len(data)
    if platform == "nes" and data[:4] == b"NES\x1a":
        return Normal(data[INES:], "ines", data[:INES])
    if platform == "nes" and size % 1024 == COPIER and data[8:10] == b"\xaa\xbb":
        return Normal(data[COPIER:], "ffe", data[:COPIER])
    if platform == "lynx" and data[:4] == b"LYNX":
        return Normal(data[LYNX:], "lynx", data[:LYNX])
    if platform == "n64" and data[:4] in N64_ORDERS:
        order = N64_ORDERS[data[:4]]
        return Normal(data if order == "z64" else swapped(data, 2 if order == "v64" else 4), order)
    if platform in ("genesis", "sms") and size % SMD_BLOCK == COPIER and size > COPIER:
        if data[8:10] == b"\xaa\xbb":
            return Normal(deinterleaved(data[COPIER:]), "smd", data[:COPIER])
        return Normal(data[COPIER:], "copier", data[:COPIER]) if platform == "sms" else Normal(data)
    if platform in ("snes", "pce", "gb", "sms") and size & 0xFFF == 0x200:
        return Normal(data[COPIER:], "copier", data[:COPIER])
    return Normal(data)


def restore(n: Normal) -> bytes:
    if n.shape == "v64":
        return swapped(n.data, 2)
    if n.shape == "n64":
        return swapped(n.data, 4)
    if n.shape == "smd":
        return n.header + interleaved(n.data)
    return n.header + n.data


def normalize_images(images: DataFrame) -> DataFrame:
    """(image_id, shape, header, bytes) of (image_id, platform, bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n = normalize(batch.column(2)[k].as_py() or b"", batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), pa.array([n.shape]), pa.array([n.header], pa.binary()), pa.array([n.data], pa.binary())],
                    names=["image_id", "shape", "header", "bytes"],
                )

    return images.select("image_id", "platform", "bytes").mapInArrow(work, "image_id long, shape string, header binary, bytes binary")
