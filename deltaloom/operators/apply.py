"""Applying and undoing patches.

Images of one row: :func:`run` works on bytes, a record class at a time, and :func:`apply_patches` deals rows
of (patch, source), which is parallel over patches without a shuffle. Images cut into chunks:
:func:`overlay_chunks` and :func:`xor_chunks` join records to the chunks they touch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.wire import Patch, Record, WireError, parse
from .images import CHUNK


def resized(source: bytes, size: int) -> bytearray:
    return bytearray(source[:size]) + bytes(max(0, size - len(source)))


def filled(r: Record) -> bytes:
    return r.payload if r.payload is not None else bytes([r.fill]) * r.len


def overlay(p: Patch, source: bytes, size: int, inside: bool) -> bytes:
    """Records over the source, in wire order: a later one wins. ``inside``: a record beyond the end refuses,
    else it is cut."""
    out = resized(source, size)
    for k, r in enumerate(p.records):
        if r.off < 0:
            raise WireError(f"negative offset at record {k}")
        if r.off + r.len > size:
            if inside:
                raise WireError(f"record {k} ends past the output")
            n = max(0, size - r.off)
            out[r.off : r.off + n] = filled(r)[:n]
        elif r.len:
            out[r.off : r.off + r.len] = filled(r)
    return bytes(out)


def record_end(p: Patch) -> int:
    return max((r.off + r.len for r in p.records if r.len), default=0)


def xor(out: bytearray, off: int, mask: bytes) -> None:
    n = min(len(mask), len(out) - off)
    if n > 0:
        part = np.frombuffer(bytes(out[off : off + n]), np.uint8) ^ np.frombuffer(mask[:n], np.uint8)
        out[off : off + n] = part.tobytes()


def forward(out: bytearray, src: int, n: int) -> None:
    """Append ``n`` bytes of what is there from ``src`` on, byte by byte in effect: a copy that reaches its
    own output repeats with the distance as period."""
    have = len(out) - src
    if have <= 0:
        raise WireError("copy ahead of the output")
    part = bytes(out[src : src + n])
    out += (part * (n // have + 1))[:n] if n > have else part


def within(data: bytes, off: int, n: int) -> bytes:
    if off < 0 or off + n > len(data):
        raise WireError("copy from outside the source")
    return data[off : off + n]


def run(p: Patch, source: bytes) -> bytes:
    """The target of a patch and its source."""
    f = p.format
    if f in ("IPS", "IPS32", "EBP"):
        natural = max(len(source), record_end(p))
        cut = p.meta.get("truncation")
        honored = cut is not None and cut < natural
        return overlay(p, source, cut if honored else natural, not honored)
    if f in ("PPF1", "PPF2", "PPF3", "NINJA1", "PMSR"):
        return overlay(p, source, max(len(source), record_end(p)), True)
    if f == "PPF4":
        old = Patch(f, [r for r in p.records if r.op == "replace"])
        return overlay(old, source, len(source), True) + b"".join(r.payload for r in p.records if r.op == "append")
    if f == "APS-N64":
        return overlay(p, source, p.target_size, True)
    if f == "APS-GBA":
        out = resized(source, p.target_size)
        for r in p.records:
            if r.off >= max(len(source), p.target_size):
                raise WireError("block beyond both images")
            xor(out, r.off, r.payload)
        return bytes(out)
    if f == "UPS":
        out = resized(source, p.target_size)
        for r in p.records:
            xor(out, r.off, r.payload)
        return bytes(out)
    if f == "NINJA2":
        return ninja2(p, source, p.source_size, p.target_size, "A")
    out = bytearray()
    if f == "BPS":
        at = [0, 0]
        for r in p.records:
            if r.op == "source_read":
                out += within(source, len(out), r.len)
            elif r.op == "target_read":
                out += r.payload
            else:
                k = r.op == "target_copy"
                at[k] += r.delta
                if at[k] < 0:
                    raise WireError("copy from before the start")
                if k:
                    forward(out, at[k], r.len)
                else:
                    out += within(source, at[k], r.len)
                at[k] += r.len
    elif f in ("GDIFF", "xdelta1"):
        if p.meta.get("compressed"):  # the patch is for what was inside, not for the bytes at hand
            raise WireError(f"{p.meta['compressed']} compressed when the patch was made")
        for r in p.records:
            out += r.payload if r.payload is not None else within(source, r.src_off, r.len)
    elif f == "DPS":
        out = bytearray(p.target_size)
        for r in p.records:
            out[r.off : r.off + r.len] = r.payload if r.payload is not None else within(source, r.src_off, r.len)
    elif f == "BSDiff":
        base = np.frombuffer(source, np.uint8)
        at = 0
        for r in p.records:
            old = np.zeros(len(r.payload), np.uint8)  # bytes outside the source count as zero
            a, b = max(0, at), min(len(base), at + len(old))
            if a < b:
                old[a - at : b - at] = base[a:b]
            out += (old + np.frombuffer(r.payload, np.uint8)).tobytes() + r.undo
            at += len(old) + r.delta
    elif f == "VCDIFF":
        for r in p.records:
            if r.op == "copy":
                out += within(source, r.src_off, r.len)
            elif r.op == "copy_own":
                forward(out, r.src_off, r.len)
            else:
                out += filled(r)
    else:
        raise WireError("unknown format")
    if p.target_size is not None and len(out) != p.target_size:
        raise WireError(f"made {len(out)} bytes, {p.target_size} are declared")
    return bytes(out)


def ninja2(p: Patch, data: bytes, before: int, after: int, adds: str) -> bytes:
    """Masks over the common part; what one image has beyond the other is carried (``adds``: which way it is
    appended)."""
    extra = b"".join(r.payload for r in p.records if r.op == "overflow")
    out = bytearray(data[: min(before, after)] if before >= after else data)
    out = resized(bytes(out), min(before, after)) if before != after else bytearray(data)
    if after > before:
        if p.meta.get("overflow") != adds:
            raise WireError("the part that is to be added is not carried")
        out += extra
    for r in p.records:
        if r.op == "xor":
            if r.off + r.len > max(before, after):
                raise WireError("mask beyond both images")
            xor(out, r.off, r.payload)
    return bytes(out)


def undo(p: Patch, target: bytes) -> bytes:
    """The source, where a patch can tell: masks undo themselves, carried originals are put back."""
    if p.format == "UPS":
        out = resized(target, p.source_size)
        for r in p.records:
            xor(out, r.off, r.payload)
        return bytes(out)
    if p.format == "NINJA2":
        return ninja2(p, target, p.target_size, p.source_size, "M")
    if p.format == "PPF3" and p.meta.get("undo") == "True":
        out = bytearray(target)
        for k, r in enumerate(p.records if target else ()):  # in their order; an empty image has nothing to put back
            original = r.undo or b""
            if original and r.off < 0:
                raise WireError(f"record {k}: negative offset {r.off}")
            if original and r.off + len(original) > len(out):
                raise WireError(f"record {k}: past the end of the image")
            if original:
                out[r.off : r.off + len(original)] = original
        return bytes(out)
    raise WireError("this format cannot be undone" if p.format != "PPF3" else "no originals are carried")


def undo_availability(fmt: str, carried: bool) -> str:
    return {"UPS": "self-inverse", "NINJA2": "self-inverse"}.get(fmt) or ("carried" if carried else "absent") if fmt in ("UPS", "NINJA2", "PPF3") else "unsupported"


def apply_patches(rows: DataFrame, backwards: bool = False) -> DataFrame:
    """(id, format, output, error) of rows (id, format, patch, image): the image patched, or unpatched. A patch
    that cannot be applied is a row with its error."""
    rows = rows.select("id", "format", "patch", "image")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ident, fmt, patch, image = (batch.column(i)[k].as_py() for i in range(4))
                out, error = None, None
                try:
                    out = (undo if backwards else run)(parse(fmt, patch), image or b"")
                except (WireError, IndexError, ValueError, OverflowError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ident], pa.int64()), pa.array([fmt], pa.string()), pa.array([out], pa.binary()), pa.array([error], pa.string())],
                    names=["id", "format", "output", "error"],
                )

    return rows.mapInArrow(work, "id long, format string, output binary, error string")


def touched(records: DataFrame, chunk: int) -> DataFrame:
    """Records by the chunks they touch, cut to each: image_id, chunk_no, ordinal, at (in the chunk), part."""
    size = F.octet_length("payload").cast("long")
    some = records.filter(size > 0).withColumn("chunk_no", F.explode(F.sequence(F.expr(f"off div {chunk}"), F.expr(f"(off + octet_length(payload) - 1) div {chunk}"))))
    start = F.greatest(F.col("off"), F.col("chunk_no") * chunk)
    stop = F.least(F.col("off") + size, (F.col("chunk_no") + 1) * chunk)
    part = F.col("payload").substr((start - F.col("off") + 1).cast("int"), (stop - start).cast("int"))
    return some.select("image_id", "chunk_no", "ordinal", (start - F.col("chunk_no") * chunk).cast("int").alias("at"), part.alias("part"))


def _chunkwise(chunks: DataFrame, records: DataFrame, chunk: int, put) -> DataFrame:
    """Chunks with the pieces of records that touch them. A chunk's pieces come together; chunks without any are
    passed through by the outer join."""
    pieces = touched(records, chunk).groupBy("image_id", "chunk_no").agg(F.sort_array(F.collect_list(F.struct("ordinal", "at", "part"))).alias("pieces"))
    both = chunks.join(pieces, ["image_id", "chunk_no"], "left").select("image_id", "chunk_no", "bytes", "pieces")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, parts = (batch.column(3).values.field(c) for c in ("at", "part"))
            ends = batch.column(3).offsets.to_pylist()
            for k in range(batch.num_rows):
                out, a, n = bytearray(batch.column(2)[k].as_py()), ends[k], ends[k + 1] - ends[k]
                for at, part in zip(places.slice(a, n).to_pylist(), parts.slice(a, n).to_pylist()):
                    put(out, at, part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([bytes(out)], pa.binary())], names=["image_id", "chunk_no", "bytes"])

    return both.mapInArrow(work, chunks.select("image_id", "chunk_no", "bytes").schema)


def _write(out: bytearray, at: int, part: bytes) -> None:
    out[at : at + len(part)] = part[: max(0, len(out) - at)]


def overlay_chunks(chunks: DataFrame, records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Records written over chunked images (image_id, chunk_no, bytes), the later in wire order last."""
    return _chunkwise(chunks, records, chunk, _write)


def xor_chunks(chunks: DataFrame, records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Masks put on chunked images; the same call takes them off."""
    return _chunkwise(chunks, records, chunk, xor)
