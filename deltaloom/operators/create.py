"""Creating patches. Encoders are not unique; what counts is that applying gives the target back.

Direct formats write the hunks in which two images differ; differential ones tile the target with copies and
literals. One row (id, source, target) makes one patch, in parallel over rows and without a shuffle.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.checksums import adler32, crc16
from ..sources.wire import NINJA2_FIELDS, WireError
from .diff import differing, runs

#: Bytes that a hunk costs besides its payload, as the largest gap worth closing.
GAPS = {"IPS": 4, "EBP": 4, "IPS32": 5}
#: Offsets that spell a format's end marker.
SENTINELS = {"IPS": 0x454F46, "EBP": 0x454F46, "IPS32": 0x45454F46, "NINJA1": 0x454F46}


def hunks(source: bytes, target: bytes, gap: int = 5) -> list[tuple[int, int]]:
    """Where the target differs, runs up to ``gap`` bytes apart closed."""
    s, e = runs(differing(source, target))
    if not len(s):
        return []
    fresh = np.append(True, s[1:] - e[:-1] > gap)
    first = np.flatnonzero(fresh)
    return list(zip(s[first].tolist(), np.append(e[first[1:] - 1], e[-1]).tolist()))


def pieces(found: list[tuple[int, int]], cap: int, sentinel: int | None = None) -> Iterator[tuple[int, int]]:
    """Hunks cut to the payload cap; one that would start at the sentinel takes the byte before it along."""
    for s, e in found:
        while s < e:
            start = s - 1 if s == sentinel else s
            stop = min(e, start + cap)
            yield start, stop
            s = stop


def long_runs(data: bytes, s: int, e: int, least: int) -> Iterator[tuple[int, int, bool]]:
    """A hunk as stretches: (start, end, whether it is one byte repeated)."""
    part = np.frombuffer(data, np.uint8)[s:e]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    at = 0
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a >= least:
            if at < a:
                yield s + at, s + a, False
            yield s + a, s + b, True
            at = b
    if at < len(part):
        yield s + at, e, False


def tiles(source: bytes, target: bytes, width: int = 16) -> list[tuple[int, int, int | None]]:
    """The target as (start, length, source position or none): copies of ``width`` bytes and more where an
    index of the source's aligned tiles, or the same place, has them; literals between."""
    index: dict[bytes, int] = {}
    for k in range(0, len(source) - width + 1, width):
        index.setdefault(source[k : k + width], k)
    out, i, lit, n = [], 0, 0, len(target)
    while i + width <= n:
        tile = target[i : i + width]
        at = i if source[i : i + width] == tile else index.get(tile)
        if at is None:
            i += 1
            continue
        back = 0
        while back < i - lit and at - back > 0 and source[at - back - 1] == target[i - back - 1]:
            back += 1
        length, step = width, 4096
        while step:
            a, b = source[at + length : at + length + step], target[i + length : i + length + step]
            if len(a) == step and a == b:
                length += step
            else:
                step //= 2
        if i - back > lit:
            out.append((lit, i - back - lit, None))
        out.append((i - back, length + back, at - back))
        i = lit = i + length
    if lit < n:
        out.append((lit, n - lit, None))
    return out


def byuu(v: int) -> bytes:
    out = bytearray()
    while True:
        b, v = v & 0x7F, v >> 7
        if not v:
            out.append(b | 0x80)
            return bytes(out)
        out.append(b)
        v -= 1


def base128(v: int) -> bytes:
    out = [v & 0x7F]
    while v := v >> 7:
        out.append(v & 0x7F | 0x80)
    return bytes(reversed(out))


def edsio(v: int) -> bytes:
    out = bytearray()
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    return bytes([*out, v])


def packed(v: int) -> bytes:
    raw = v.to_bytes(max(1, (v.bit_length() + 7) // 8), "little")
    return bytes([len(raw)]) + raw


def field(value: str | None, width: int, pad: bytes = b"\0") -> bytes:
    """A text in a fixed width, cut on a character's edge."""
    raw = (value or "").encode()[:width].decode("utf-8", "ignore").encode()
    return raw.ljust(width, pad)


def refuse_size(fmt: str, source: bytes, target: bytes) -> None:
    a, b = len(source), len(target)
    if fmt in ("PPF1", "PPF3") and a != b:
        raise WireError("a change of size cannot be written")
    if fmt in ("IPS32", "EBP", "PPF2", "PPF4", "NINJA1", "PMSR") and b < a:
        raise WireError("a shrink cannot be written")
    if fmt == "PPF2" and a < 0x9320 + 1024:
        raise WireError("the source is too small for its check")
    if fmt == "IPS" and (b > 0xFFFFFF + 0xFFFF if b > a else b < a and b > 0xFFFFFF):
        raise WireError("the target is beyond the format")
    if fmt == "UPS" and any(source[b:]):
        raise WireError("the source has more than zeros beyond the target")


def ips(fmt, s, t, meta):
    wide = fmt == "IPS32"
    width, sentinel = (4 if wide else 3), SENTINELS[fmt]
    out = [b"IPS32" if wide else b"PATCH"]
    for a, b in hunks(s, t, GAPS[fmt]):
        for x, y, same in long_runs(t, a, b, 3 * (width + 3)):
            for u, v in pieces([(x, y)], 0xFFFF, sentinel):
                if u >= 1 << 8 * width:
                    raise WireError("offset beyond the format")
                head = u.to_bytes(width, "big")
                out.append(head + (struct.pack(">HHB", 0, v - u, t[u]) if same and u >= x else struct.pack(">H", v - u) + t[u:v]))
    out.append(b"EEOF" if wide else b"EOF")
    if fmt == "IPS" and len(t) < len(s):
        out.append(len(t).to_bytes(3, "big"))
    if fmt == "EBP":
        out.append(json.dumps({"patcher": "EBPatcher"} | {k: meta.get(k) or "" for k in ("title", "author", "description")}).encode())
    return b"".join(out)


def ppf(fmt, s, t, meta):
    n = int(fmt[3])
    out = [b"PPF%d0" % n + bytes([n - 1]) + field(meta.get("description"), 50, b" ")]
    if n == 2:
        out.append(struct.pack("<I", len(s)) + s[0x9320 : 0x9320 + 1024])
    if n == 3:
        block = s[0x9320 : 0x9320 + 1024]
        out.append(bytes([0, len(block) == 1024, 1, 0]) + (block if len(block) == 1024 else b""))
    if n == 4:
        out.append(bytes(4))
    cut = [(a, min(b, len(s))) for a, b in hunks(s, t) if a < len(s)] if n == 4 else hunks(s, t)
    for a, b in pieces(cut, 255):
        if n == 3:
            out.append(struct.pack("<qB", a, b - a) + t[a:b] + s[a:b])
        else:
            out.append((b"\0" if n == 4 else b"") + struct.pack("<IB", a, b - a) + t[a:b])
    if n == 4:
        out += [b"\1" + struct.pack("<IB", 0, b - a) + t[a:b] for a, b in pieces([(len(s), len(t))], 255)]
    return b"".join(out)


def ninja1(fmt, s, t, meta):
    out = [b"NINJA1B", bytes([0]), zlib.crc32(s).to_bytes(4, "big"), hashlib.md5(s).digest(), hashlib.sha1(s).digest()]
    big = lambda v: v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big")
    for a, b in pieces(hunks(s, t), 1 << 62, SENTINELS[fmt]):
        for raw in (big(a), big(b - a)):
            out += [bytes([len(raw)]), raw]
        out.append(t[a:b])
    return b"".join([*out, b"\3EOF"])


def pmsr(fmt, s, t, meta):
    found = list(pieces(hunks(s, t), 0x7FFFFFFF))
    return b"PMSR" + struct.pack(">I", len(found)) + b"".join(struct.pack(">iI", a, b - a) + t[a:b] for a, b in found)


def aps_n64(fmt, s, t, meta):
    out = [b"APS10\0\0", field(meta.get("description"), 50, b" "), struct.pack("<I", len(t))]
    for a, b in hunks(s, t):
        for x, y, same in long_runs(t, a, b, 16):
            for u, v in pieces([(x, y)], 255):
                out.append(struct.pack("<IB", u, 0 if same else v - u) + (bytes([t[u], v - u]) if same else t[u:v]))
    return b"".join(out)


def masked(s: bytes, t: bytes, a: int, b: int) -> bytes:
    x, y = (np.frombuffer(d[a:b].ljust(b - a, b"\0"), np.uint8) for d in (s, t))
    return (x ^ y).tobytes()


def aps_gba(fmt, s, t, meta):
    out = [b"APS1", struct.pack("<II", len(s), len(t))]
    for a in range(0, max(len(s), len(t)), 65536):
        x, y = s[a : a + 65536], t[a : a + 65536]
        if x.ljust(65536, b"\0") != y.ljust(65536, b"\0"):
            out.append(struct.pack("<IHH", a, crc16(x), crc16(y)) + masked(s, t, a, a + 65536))
    return b"".join(out)


def seal(body: bytes, s: bytes, t: bytes) -> bytes:
    body += struct.pack("<II", zlib.crc32(s), zlib.crc32(t))
    return body + struct.pack("<I", zlib.crc32(body))


def ups(fmt, s, t, meta):
    out, at, n = [b"UPS1", byuu(len(s)), byuu(len(t))], 0, max(len(s), len(t))
    x, y = (np.frombuffer(d.ljust(n, b"\0"), np.uint8) for d in (s, t))
    for a, b in zip(*(e.tolist() for e in runs(x != y))):
        out += [byuu(a - at), masked(s, t, a, b), b"\0"]
        at = b + 1
    return seal(b"".join(out), s, t)


def bps(fmt, s, t, meta):
    about = (meta.get("metadata") or "").encode()
    out, moved = [b"BPS1", byuu(len(s)), byuu(len(t)), byuu(len(about)), about], [0, 0]

    def action(kind: int, n: int, rest: bytes = b"") -> None:
        out.append(byuu((n - 1) << 2 | kind) + rest)

    def jump(k: int, to: int, n: int) -> bytes:
        d = to - moved[k]
        moved[k] = to + n
        return byuu(abs(d) << 1 | (d < 0))

    for a, n, src in tiles(s, t):
        if src == a:
            action(0, n)
        elif src is not None:
            action(2, n, jump(0, src, n))
        else:
            for x, y, same in long_runs(t, a, a + n, 12):
                if not same:
                    action(1, y - x, t[x:y])
                else:  # one byte, and a copy of the output from one byte back
                    action(1, 1, t[x : x + 1])
                    action(3, y - x - 1, jump(1, x, y - x - 1))
    return seal(b"".join(out), s, t)


def dps(fmt, s, t, meta):
    out = [field(meta.get(k), 64) for k in ("title", "author", "patch-version")] + [bytes([0, 1]), struct.pack("<I", len(s))]
    at = 0
    for a, b in [*hunks(s, t), (len(t), len(t))]:
        if at < a:
            out.append(b"\0" + struct.pack("<III", at, at, a - at))
        if a < b:
            out.append(b"\1" + struct.pack("<II", a, b - a) + t[a:b])
        at = b
    return b"".join(out)


def ninja2(fmt, s, t, meta):
    out = [b"NINJA2\1", *(field(meta.get(name), n) for name, n in NINJA2_FIELDS), b"\1", packed(0), b"\0"]
    out += [packed(len(s)), packed(len(t)), hashlib.md5(s).digest(), hashlib.md5(t).digest()]
    n = min(len(s), len(t))
    if len(s) != len(t):
        extra = bytes(b ^ 0xFF for b in (s if len(s) > n else t)[n:])
        out += [b"M" if len(s) > n else b"A", packed(len(extra)), extra]
    for a, b in hunks(s[:n], t[:n]):
        out += [b"\2", packed(a), packed(b - a), masked(s, t, a, b)]
    return b"".join([*out, b"\0"])


def gdiff(fmt, s, t, meta):
    out = [b"\xd1\xff\xd1\xff\4"]
    for a, n, src in tiles(s, t):
        if src is None:
            for x, y in pieces([(a, a + n)], 0x7FFFFFFF):
                k = y - x
                out.append((bytes([k]) if k < 247 else b"\xf7" + struct.pack(">H", k) if k < 1 << 16 else b"\xf8" + struct.pack(">I", k)) + t[x:y])
        elif src < 1 << 16:
            out.append(b"\xf9" + struct.pack(">HB", src, n) if n < 256 else b"\xfa" + struct.pack(">HH", src, n) if n < 1 << 16 else b"\xfb" + struct.pack(">Hi", src, n))
        else:
            out.append(b"\xfc" + struct.pack(">iB", src, n) if n < 256 else b"\xfd" + struct.pack(">iH", src, n) if n < 1 << 16 else b"\xfe" + struct.pack(">ii", src, n))
    return b"".join([*out, b"\0"])


def bsdiff(fmt, s, t, meta):
    number = lambda v: (abs(v) | (1 << 63 if v < 0 else 0)).to_bytes(8, "little")
    control, diff, extra, at = [], [], [], 0
    steps = tiles(s, t)
    while steps:
        a, n, src = steps.pop(0)
        lit, add = (a, 0) if src is None else (a + n, n)
        more = n if src is None else steps.pop(0)[1] if steps and steps[0][2] is None else 0
        extra.append(t[lit : lit + more])
        diff.append(bytes(add))
        after = steps[0][2] if steps else at + add
        if src is not None and src != at:  # only the first step can start elsewhere
            control.append((0, 0, src - at))
            at = src
        control.append((add, more, after - (at + add)))
        at = after
    blocks = [bz2.compress(b"".join(x)) for x in ([number(v) for c in control for v in c], diff, extra)]
    return b"BSDIFF40" + number(len(blocks[0])) + number(len(blocks[1])) + number(len(t)) + b"".join(blocks)


def vcdiff(fmt, s, t, meta):
    adds, code, where = [], [], []
    found = tiles(s, t)
    size = len(s) if any(x[2] is not None for x in found) else 0
    for a, n, src in found:
        if src is not None:
            code.append(b"\x13" + base128(n))
            where.append(base128(src))
        else:
            for x, y, same in long_runs(t, a, a + n, 8):
                code.append((b"\0" if same else b"\1") + base128(y - x))
                adds.append(t[x : x + 1] if same else t[x:y])
    parts = [b"".join(x) for x in (adds, code, where)]
    body = base128(len(t)) + b"\0" + b"".join(base128(len(x)) for x in parts) + struct.pack(">I", adler32(t)) + b"".join(parts)
    segment = base128(size) + base128(0) if size else b""
    return b"\xd6\xc3\xc4\0\0" + bytes([4 | bool(size)]) + segment + base128(len(body)) + body


def xdelta1(fmt, s, t, meta):
    found = tiles(s, t)
    store = b"".join(t[a : a + n] for a, n, src in found if src is None)
    # the data segment is read on from where the last literal ended; its record comes first
    copies = any(src is not None for _, _, src in found)
    sources = [(b"", hashlib.md5(store).digest(), len(store), 1, 1)] if store else []
    sources += [(b"", hashlib.md5(s).digest(), len(s), 0, 0)] if copies else []
    control = [bytes(8), hashlib.md5(t).digest(), edsio(len(t)), bytes([bool(store)]), edsio(len(sources))]
    for name, md5, size, kind, mode in sources:
        control += [edsio(len(name)), name, md5, edsio(size), bytes([kind, mode])]
    control.append(edsio(len(found)))
    for _, n, src in found:
        control.append(edsio(0 if src is None else len(sources) - 1) + edsio(0 if src is None else src) + edsio(n))
    squeeze = lambda raw: gzip.compress(raw, mtime=0) if raw else raw
    head = b"%XDZ004%" + struct.pack(">II", 8, 0) + bytes(16)
    body = squeeze(store)
    return head + body + squeeze(b"".join(control)) + struct.pack(">I", len(head) + len(body)) + b"%XDZ004%"


ENCODERS = {
    "IPS": ips, "IPS32": ips, "EBP": ips, "PPF1": ppf, "PPF2": ppf, "PPF3": ppf, "PPF4": ppf, "NINJA1": ninja1, "PMSR": pmsr,
    "APS-N64": aps_n64, "APS-GBA": aps_gba, "BPS": bps, "UPS": ups, "DPS": dps, "NINJA2": ninja2, "GDIFF": gdiff, "BSDiff": bsdiff,
    "VCDIFF": vcdiff, "xdelta1": xdelta1,
}

#: File extensions that name a format to create.
EXTENSIONS = {
    "ips": "IPS", "ips32": "IPS32", "ebp": "EBP", "ppf": "PPF3", "bps": "BPS", "ups": "UPS", "aps": "APS-N64", "rup": "NINJA2", "dps": "DPS",
    "gdiff": "GDIFF", "gdf": "GDIFF", "bsdiff": "BSDiff", "vcdiff": "VCDIFF", "xdelta": "VCDIFF", "mod": "PMSR",
}


def format_of(name: str | None) -> str:
    """The format that a token or a file name asks for; BPS if none is asked for (C14)."""
    if not name:
        return "BPS"
    by_token = {f.lower(): f for f in ENCODERS}
    found = by_token.get(name.lower()) or EXTENSIONS.get(name.lower().rpartition(".")[2])
    if not found:
        raise WireError(f"no format is named {name!r}")
    return found


def create(fmt: str, source: bytes, target: bytes, meta: dict | None = None) -> bytes:
    if fmt not in ENCODERS:
        raise WireError("unknown format")
    refuse_size(fmt, source, target)
    return ENCODERS[fmt](fmt, source, target, meta or {})


def create_patches(pairs: DataFrame, fmt: str) -> DataFrame:
    """(id, format, patch, error) of rows (id, source, target). A pair that the format cannot carry is a row with
    its error."""
    pairs = pairs.select("id", "source", "target")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ident, source, target = (batch.column(i)[k].as_py() for i in range(3))
                out, error = None, None
                try:
                    out = create(fmt, source or b"", target or b"")
                except WireError as e:
                    error = str(e)
                except (OverflowError, struct.error):  # a number that the format has no room for
                    error = "a value beyond the format"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ident], pa.int64()), pa.array([fmt]), pa.array([out], pa.binary()), pa.array([error], pa.string())], names=["id", "format", "patch", "error"]
                )

    return pairs.mapInArrow(work, "id long, format string, patch binary, error string")
