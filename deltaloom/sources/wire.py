"""Reading patches: a cursor over bytes, and a decoder for each format.

A decoder returns a :class:`Patch`; what a format forbids raises :class:`WireError`, which callers turn into a
row, never into a failed job. Records are kept in wire order, which decides overlaps.
"""

from __future__ import annotations

import bz2
import json
import lzma
import struct
import zlib
from dataclasses import dataclass, field

from ..functions.checksums import adler32

INT64 = (1 << 63) - 1


class WireError(Exception):
    """A patch that its format does not allow."""


@dataclass
class Record:
    op: str
    off: int = 0
    len: int = 0
    payload: bytes | None = None
    fill: int | None = None
    delta: int | None = None
    src_off: int | None = None
    undo: bytes | None = None
    window_no: int | None = None


@dataclass
class Patch:
    format: str
    records: list[Record] = field(default_factory=list)
    source_size: int | None = None
    target_size: int | None = None
    meta: dict = field(default_factory=dict)
    checks: list[tuple[str, str, str, str]] = field(default_factory=list)  # side, kind, expected, severity
    advisories: list[str] = field(default_factory=list)

    def check(self, side: str, kind: str, expected, severity: str = "fatal") -> None:
        self.checks.append((side, kind, str(expected), severity))


class Cursor:
    """Reads forward; past the end is an error."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def left(self) -> int:
        return self.end - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.left():
            raise WireError(f"truncated: {n} bytes wanted at {self.at}, {self.left()} left")
        self.at += n
        return self.data[self.at - n : self.at]

    def u8(self) -> int:
        return self.take(1)[0]

    def be(self, n: int, signed: bool = False) -> int:
        return int.from_bytes(self.take(n), "big", signed=signed)

    def le(self, n: int, signed: bool = False) -> int:
        return int.from_bytes(self.take(n), "little", signed=signed)

    def byuu(self) -> int:
        """7 bits a byte, low first, the high bit ends; each continuation adds one of its place."""
        value, place = 0, 1
        while True:
            b = self.u8()
            value += (b & 0x7F) * place
            if b & 0x80:
                break
            place <<= 7
            value += place
        if value > INT64:
            raise WireError("number too large")
        return value

    def base128(self) -> int:
        """7 bits a byte, high first, the high bit continues."""
        value = 0
        while True:
            b = self.u8()
            value = value << 7 | b & 0x7F
            if value > INT64:
                raise WireError("number too large")
            if not b & 0x80:
                return value

    def edsio(self) -> int:
        """7 bits a byte, low first, the high bit continues; 32 bits at most."""
        value, shift = 0, 0
        while True:
            b = self.u8()
            value |= (b & 0x7F) << shift
            shift += 7
            if value >> 32:
                raise WireError("number too large")
            if not b & 0x80:
                return value

    def packed(self) -> int:
        """A count and so many bytes, low first."""
        value = self.le(self.u8())
        if value > INT64:
            raise WireError("number too large")
        return value

    def signed_byuu(self) -> int:
        v = self.byuu()
        return -(v >> 1) if v & 1 else v >> 1


def text(raw: bytes) -> str | None:
    """A fixed-width field: up to the first NUL, without blanks at its end; null if that is empty."""
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace").rstrip() or None


def expect(c: Cursor, magic: bytes) -> None:
    if c.data[c.at : c.at + len(magic)] != magic:
        raise WireError("bad magic")
    c.at += len(magic)


def ips(data: bytes) -> Patch:
    wide = data[:5] == b"IPS32"
    c, p = Cursor(data), Patch("IPS32" if wide else "IPS")
    expect(c, b"IPS32" if wide else b"PATCH")
    stop, width = (b"EEOF", 4) if wide else (b"EOF", 3)
    while True:
        if c.left() < width:
            p.advisories.append("truncated")
            return p
        if c.data[c.at : c.at + width] == stop:
            c.at += width
            break
        start = c.at
        try:
            off, size = c.be(width), c.be(2)
            if size:
                p.records.append(Record("copy", off, size, c.take(size)))
            else:
                count, fill = c.be(2), c.u8()
                if not count:
                    p.advisories.append("zero-count run")
                p.records.append(Record("rle", off, count, fill=fill))
        except WireError:
            c.at = start
            p.advisories.append("truncated")
            return p
    rest = c.take(c.left())
    if wide:
        p.advisories += ["trailing bytes"] if rest else []
    elif len(rest) == 3 and rest[:1] != b"{":
        p.meta["truncation"] = int.from_bytes(rest, "big")
    elif rest[:1] == b"{":
        p.format = "EBP"
        try:
            found = json.loads(rest)
        except ValueError as e:
            raise WireError("bad metadata") from e
        p.meta |= {k.lower(): v for k, v in found.items() if isinstance(v, str)}
    elif rest:
        raise WireError("trailing bytes")
    return p


def diz(body: bytes, width: int, order: str = "little") -> tuple[bytes, str | None]:
    """A file-id trailer, found from the end, split off."""
    head, tail = b"@BEGIN_FILE_ID.DIZ", b"@END_FILE_ID.DIZ"
    if len(body) < width + len(tail):
        return body, None
    n = int.from_bytes(body[-width:], order)
    stop = len(body) - width - len(tail)
    start = stop - n - len(head)
    if start < 0 or body[stop : stop + len(tail)] != tail or body[start : start + len(head)] != head:
        return body, None
    return body[:start], body[start + len(head) : stop].decode("utf-8", "replace")


def ppf1(data: bytes, order: str = "little") -> Patch:
    c, p = Cursor(data), Patch("PPF1")
    expect(c, b"PPF1")
    if c.be(2) & 0xFF:
        raise WireError("unknown encoding method")
    p.meta["description"] = text(c.take(50))
    while c.left() >= 5:
        off = int.from_bytes(c.take(4), order, signed=True)
        n = c.u8()
        if n:
            p.records.append(Record("copy", off, n, c.take(n)))
        else:
            fill, count = c.u8(), c.u8()
            p.records.append(Record("rle", off, count, bytes([fill]) * count, fill))
    return p


def ppf2(data: bytes) -> Patch:
    c, p = Cursor(data), Patch("PPF2")
    expect(c, b"PPF2")
    c.take(2)
    p.meta["description"] = text(c.take(50))
    p.source_size = c.le(4)
    p.check("source", "size", p.source_size, "advisory")
    p.check("source", "block@37664+1024", c.take(1024).hex(), "advisory")
    body, p.meta["diz"] = diz(c.take(c.left()), 4)
    c = Cursor(body)
    while c.left() >= 5:
        off, n = c.le(4, True), c.u8()
        p.records.append(Record("write", off, n, c.take(n)))
    return p


def ppf3(data: bytes) -> Patch:
    c, p = Cursor(data), Patch("PPF3")
    expect(c, b"PPF3")
    if c.be(2) & 0xFF != 2:
        raise WireError("unknown encoding method")
    p.meta["description"] = text(c.take(50))
    image, block, undo = c.u8(), c.u8(), c.u8()
    c.take(1)
    p.meta |= {"image_type": "GI" if image else "BIN", "undo": str(bool(undo))}
    if block:
        p.check("source", f"block@{0x80A0 if image else 0x9320}+1024", c.take(1024).hex(), "advisory")
    body, p.meta["diz"] = diz(c.take(c.left()), 2)
    c = Cursor(body)
    while c.left() >= 9:
        off, n = c.le(8, True), c.u8()
        p.records.append(Record("write", off, n, c.take(n), undo=c.take(n) if undo else None))
    return p


def ppf4(data: bytes) -> Patch:
    c, p = Cursor(data), Patch("PPF4")
    expect(c, b"PPF4")
    c.take(2)
    p.meta["description"] = text(c.take(50))
    if any(c.take(4)):
        raise WireError("reserved header bytes")
    appending = False
    while c.left():
        command, off, n = c.u8(), c.le(4), c.u8()
        if command > 1:
            raise WireError(f"unknown command {command}")
        if appending and not command:
            raise WireError(f"replace after append at record {len(p.records)}")
        appending = bool(command)
        p.records.append(Record("append" if command else "replace", 0 if command else off, n, c.take(n)))
    return p


def ninja1(data: bytes) -> Patch:
    c, p = Cursor(data), Patch("NINJA1")
    expect(c, b"NINJA1")
    kind = c.u8()  # B binary, T text; lower case: zlib
    body = c.take(c.left())
    if kind in b"bt":
        try:
            body = zlib.decompress(body)
        except zlib.error as e:
            raise WireError("bad compression") from e
    elif kind not in b"BT":
        raise WireError("unknown sub-format")
    sums = ("crc32", "md5", "sha1")
    if kind in b"Tt":
        lines = [x.rstrip("\r") for x in body.decode("latin-1").split("\n")]
        lines = [x for x in lines if x and x[0] != "#"]
        if not lines or not lines[0].split():
            raise WireError("empty text patch")
        p.meta["rom_type"], *found = lines[0].split()
        for name, value in zip(sums, found):
            if value not in ("unk", "unk."):
                p.check("source", name, value.lower().zfill(8))
        for line in lines[1:]:
            try:
                off, payload = line.split()
                payload = bytes.fromhex(payload)
                p.records.append(Record("write", int(off, 16), len(payload), payload))
            except ValueError as e:
                raise WireError(f"bad line {line[:40]!r}") from e
        return p
    c = Cursor(body)
    p.meta["rom_type"] = str(c.u8())
    for name, n in zip(sums, (4, 16, 20)):
        value = c.take(n)
        if any(value):
            p.check("source", name, value.hex())
    while True:
        if not c.left():
            raise WireError("no footer")
        width = c.u8()
        where = c.take(width)
        if width == 3 and where == b"EOF":
            break
        if not width:
            raise WireError("no footer")
        n = c.be(c.u8())
        p.records.append(Record("write", int.from_bytes(where, "big"), n, c.take(n)))
    p.advisories += ["trailing bytes"] if c.left() else []
    return p


def pmsr(data: bytes) -> Patch:
    c, p = Cursor(data), Patch("PMSR")
    expect(c, b"PMSR")
    for k in range(c.be(4)):
        off, n = c.be(4, True), c.be(4)
        if off < 0:
            raise WireError(f"negative offset at record {k}")
        p.records.append(Record("write", off, n, c.take(n)))
    p.advisories += ["trailing bytes"] if c.left() else []
    return p


def aps_n64(data: bytes) -> Patch:
    c, p = Cursor(data), Patch("APS-N64")
    expect(c, b"APS10")
    kind, encoding = c.u8(), c.u8()
    if kind > 1 or encoding:
        raise WireError("unknown type or encoding")
    p.meta["description"] = text(c.take(50))
    if kind:
        p.meta["image_format"] = str(c.u8())
        p.check("source", "bytes@60+2", c.take(2).hex(), "advisory")
        p.check("source", "bytes@62+1", c.take(1).hex(), "advisory")
        p.check("source", "bytes@16+8", c.take(8).hex(), "advisory")
        c.take(5)
    p.target_size = c.le(4)
    while c.left():
        if c.left() < 5:
            p.advisories.append("trailing fragment")
            break
        off, n = c.le(4), c.u8()
        if n:
            p.records.append(Record("copy", off, n, c.take(n)))
        else:
            fill, count = c.u8(), c.u8()
            p.records.append(Record("rle", off, count, bytes([fill]) * count, fill))
    return p


def aps_gba(data: bytes) -> Patch:
    c, p = Cursor(data), Patch("APS-GBA")
    expect(c, b"APS1")
    p.source_size, p.target_size = c.le(4), c.le(4)
    p.check("source", "size", p.source_size, "advisory")
    while c.left():
        off, source, target = c.le(4), c.le(2), c.le(2)
        p.check("source", f"crc16@{off}+65536", source, "advisory")
        p.check("target", f"crc16@{off}+65536", target, "advisory")
        p.records.append(Record("xor", off, 65536, c.take(65536)))
    return p


def sealed(data: bytes, magic: bytes) -> tuple[Cursor, int, int]:
    """A patch that ends with three checksums, the last of which is its own."""
    if len(data) < len(magic) + 12:
        raise WireError("too short")
    source, target, own = struct.unpack("<III", data[-12:])
    c = Cursor(data, 0, len(data) - 12)
    expect(c, magic)
    if zlib.crc32(data[:-4]) != own:
        raise WireError("the patch's own checksum is wrong")
    return c, source, target


def bps(data: bytes) -> Patch:
    c, source, target = sealed(data, b"BPS1")
    p = Patch("BPS", source_size=c.byuu(), target_size=c.byuu())
    p.meta["metadata"] = c.take(c.byuu()).decode("utf-8", "replace") or None
    p.check("source", "crc32", f"{source:08x}")
    p.check("source", "size", p.source_size, "advisory")
    p.check("target", "crc32", f"{target:08x}")
    out = 0
    while c.left():
        head = c.byuu()
        kind, n = head & 3, (head >> 2) + 1
        r = Record(("source_read", "target_read", "source_copy", "target_copy")[kind], out, n)
        if kind == 1:
            r.payload = c.take(n)
        elif kind > 1:
            r.delta = c.signed_byuu()
        p.records.append(r)
        out += n
    return p


def ups(data: bytes) -> Patch:
    c, source, target = sealed(data, b"UPS1")
    p = Patch("UPS", source_size=c.byuu(), target_size=c.byuu())
    p.check("source", "crc32", f"{source:08x}")
    p.check("source", "size", p.source_size, "advisory")
    p.check("target", "crc32", f"{target:08x}")
    at = 0
    while c.left():
        at += c.byuu()
        stop = c.data.find(b"\0", c.at, c.end)
        if stop < 0:
            raise WireError("block without an end")
        mask = c.take(stop - c.at)
        c.at += 1
        p.records.append(Record("xor", at, len(mask), mask))
        at += len(mask) + 1
    return p


def dps(data: bytes) -> Patch:
    c, p = Cursor(data), Patch("DPS")
    p.meta |= {k: text(c.take(64)) for k in ("title", "author", "patch-version")}
    stability, version = c.u8(), c.u8()
    if stability > 1 or version != 1:
        raise WireError("unknown flag")
    p.meta["stability"] = str(stability)
    p.source_size = c.le(4)
    p.check("source", "size", p.source_size)
    while c.left():
        mode, off = c.u8(), c.le(4)
        if mode == 0:
            src, n = c.le(4), c.le(4)
            p.records.append(Record("copy", off, n, src_off=src))
        elif mode == 1:
            n = c.le(4)
            p.records.append(Record("data", off, n, c.take(n)))
        else:
            raise WireError(f"unknown record mode {mode}")
    p.target_size = max((r.off + r.len for r in p.records), default=0)
    return p


#: The text fields of the 2,048-byte header, in order after magic and encoding byte.
NINJA2_FIELDS = [
    ("author", 84), ("patch-version", 11), ("title", 256), ("genre", 48), ("language", 48), ("date", 8), ("website", 512), ("description", 1074),
]


def ninja2(data: bytes) -> Patch:
    c, p = Cursor(data), Patch("NINJA2")
    expect(c, b"NINJA2")
    if c.u8() > 1:
        raise WireError("unknown text mode")
    p.meta |= {name: text(c.take(n)) for name, n in NINJA2_FIELDS}
    files = 0
    while True:
        if not c.left():
            raise WireError("no end command")
        command = c.u8()
        if command == 0:
            break
        if command == 1:
            files += 1
            c.take(c.packed())
            rom, source, target = c.u8(), c.packed(), c.packed()
            before, after = c.take(16), c.take(16)
            extra = None
            if source != target:
                mode = c.u8()
                if mode not in b"AM":
                    raise WireError("unknown overflow mode")
                extra = (chr(mode), bytes(b ^ 0xFF for b in c.take(c.packed())))
            if files > 1:
                p.advisories.append("further file")
                continue
            p.source_size, p.target_size = source, target
            p.meta["rom_type"] = str(rom)
            for side, value in (("source", before), ("target", after)):
                if any(value):
                    p.check(side, "md5", value.hex())
            if extra:
                p.records.append(Record("overflow", min(source, target), len(extra[1]), extra[1]))
                p.meta["overflow"] = extra[0]
        elif command == 2:
            off = c.packed()
            mask = c.take(c.packed())
            if files < 2:
                p.records.append(Record("xor", off, len(mask), mask))
        else:
            raise WireError(f"unknown command {command}")
    p.advisories += ["trailing bytes"] if c.left() else []
    return p


def gdiff(data: bytes) -> Patch:
    c, p = Cursor(data), Patch("GDIFF")
    expect(c, b"\xd1\xff\xd1\xff\x04")
    #: By opcode, the bytes of a copy's offset and length
    shapes = {249: (2, 1), 250: (2, 2), 251: (2, 4), 252: (4, 1), 253: (4, 2), 254: (4, 4), 255: (8, 4)}
    out = 0
    while True:
        code = c.u8()
        if code == 0:
            break
        if code < 249:
            n = code if code < 247 else c.be(2 if code == 247 else 4)
            p.records.append(Record("data", out, n, c.take(n)))
        else:
            a, b = shapes[code]
            src, n = c.be(a, True) if a > 2 else c.be(a), c.be(b, True) if b == 4 else c.be(b)
            if src < 0 or n < 0:
                raise WireError(f"negative copy at record {len(p.records)}")
            p.records.append(Record("copy", out, n, src_off=src))
        out += p.records[-1].len
    p.target_size = out
    return p


def bsdiff(data: bytes) -> Patch:
    def number(raw: bytes) -> int:
        v = int.from_bytes(raw, "little")
        return -(v & INT64) if v >> 63 else v

    c, p = Cursor(data), Patch("BSDiff")
    expect(c, b"BSDIFF40")
    control, diff, p.target_size = (number(c.take(8)) for _ in range(3))
    if min(control, diff, p.target_size) < 0:
        raise WireError("negative size")
    try:
        control, diff, extra = (bz2.decompress(x) if x else b"" for x in (c.take(control), c.take(diff), c.take(c.left())))
    except (OSError, ValueError) as e:
        raise WireError("bad compression") from e
    if len(control) % 24:
        raise WireError("control block is cut")
    out = at = more = 0
    for k in range(0, len(control), 24):
        add, copy, seek = (number(control[k + i : k + i + 8]) for i in (0, 8, 16))
        if add < 0 or copy < 0 or at + add > len(diff) or more + copy > len(extra):
            raise WireError(f"bad triple {k // 24}")
        p.records.append(Record("add_copy_seek", out, add + copy, diff[at : at + add], delta=seek, undo=extra[more : more + copy]))
        at, more, out = at + add, more + copy, out + add + copy
    if out != p.target_size:
        raise WireError("the triples do not make the target's size")
    return p


def xdelta1(data: bytes) -> Patch:
    def inflate(raw: bytes) -> bytes:
        try:
            return zlib.decompress(raw, 31) if packed and raw else raw
        except zlib.error as e:
            raise WireError("bad compression") from e

    magic = b"%XDZ004%"
    if data[:8] != magic:
        raise WireError("unsupported version" if data[:4] == b"%XDZ" or data[:7] == b"%XDELTA" else "bad magic")
    if len(data) < 44 or data[-8:] != magic:
        raise WireError("too short, or no trailer")
    flags, names = struct.unpack(">II", data[8:16])
    packed = flags & 8
    start = 32 + (names >> 16) + (names & 0xFFFF)
    where = int.from_bytes(data[-12:-8], "big")
    if not start <= where <= len(data) - 12:
        raise WireError("bad control offset")
    p = Patch("xdelta1")
    p.meta |= {"from-name": text(data[32 : 32 + (names >> 16)]), "to-name": text(data[32 + (names >> 16) : start])}
    if flags & 6:
        p.meta["compressed"] = ["the source was", "the target was", "both were"][(flags & 6) // 2 - 1]
    store = inflate(data[start:where])
    c = Cursor(inflate(data[where:-12]))
    c.take(8)
    target = c.take(16)
    p.target_size = c.edsio()
    c.u8()
    sources = []
    for _ in range(c.edsio()):
        name = c.take(c.edsio())
        md5, size, kind, mode = c.take(16), c.edsio(), c.u8(), c.u8()
        if kind > 1 or mode > 1:
            raise WireError("bad source flag")
        sources.append((kind, mode, md5, size, name))
    if [s[0] for s in sources] not in ([], [1], [0], [1, 0]):
        raise WireError("unsupported list of sources")
    checked = not flags & 1
    if checked:
        p.check("target", "md5", target.hex())
    for kind, _, md5, size, _ in sources:
        if kind == 0:
            p.source_size = size
            p.check("source", "size", size)
            if checked:
                p.check("source", "md5", md5.hex())
        elif size != len(store):
            raise WireError("data segment has another size")
    moved, out = [0] * len(sources), 0
    for _ in range(c.edsio()):
        k, off, n = c.edsio(), c.edsio(), c.edsio()
        if k >= len(sources):
            raise WireError("unknown source")
        kind, mode = sources[k][:2]
        if mode:
            off = moved[k]
            moved[k] += n
        if kind == 1 and off + n > len(store):
            raise WireError("copy beyond the data segment")
        p.records.append(Record("data" if kind else "copy", out, n, store[off : off + n] if kind else None, src_off=off))
        out += n
    return p


def code_table() -> list[tuple[tuple[str, int, int], tuple[str, int, int]]]:
    """The default instructions: (kind, size, mode) twice, by the rule of RFC 3284, section 5.6."""
    none = ("noop", 0, 0)
    table = [(("run", 0, 0), none)]
    table += [(("add", n, 0), none) for n in range(18)]
    for mode in range(9):
        table += [(("copy", n, mode), none) for n in (0, *range(4, 19))]
    for mode in range(9):
        sizes = range(4, 7) if mode < 6 else (4,)
        table += [(("add", a, 0), ("copy", n, mode)) for a in range(1, 5) for n in sizes]
    return table + [(("copy", 4, mode), ("add", 1, 0)) for mode in range(9)]


class Addresses:
    """Near and same caches of copy addresses."""

    def __init__(self, near: int = 4, same: int = 3):
        self.near, self.same, self.slot = [0] * near, [0] * (same * 256), 0

    def decode(self, c: Cursor, here: int, mode: int) -> int:
        n = len(self.near)
        if mode == 0:
            at = c.base128()
        elif mode == 1:
            at = here - c.base128()
        elif mode < 2 + n:
            at = self.near[mode - 2] + c.base128()
        else:
            at = self.same[(mode - 2 - n) * 256 + c.u8()]
        if not 0 <= at < here:
            raise WireError("copy from an address that is not there yet")
        self.remember(at)
        return at

    def remember(self, at: int) -> None:
        if self.near:
            self.near[self.slot] = at
            self.slot = (self.slot + 1) % len(self.near)
        if self.same:
            self.same[at % len(self.same)] = at


def vcdiff(data: bytes) -> Patch:
    c, p = Cursor(data), Patch("VCDIFF")
    expect(c, b"\xd6\xc3\xc4")
    c.u8()
    bits = c.u8()
    if bits & ~7:
        raise WireError("unknown header bits")
    compressor = c.u8() if bits & 1 else None
    if bits & 2:
        raise WireError("custom code tables are not supported")
    if bits & 4:
        p.meta["metadata"] = c.take(c.base128()).decode("utf-8", "replace")
    if compressor not in (None, 2):
        raise WireError(f"secondary compressor {compressor} is not supported")
    streams: list = [None, None, None]

    def plain(raw: bytes, kind: int) -> bytes:
        """A compressed section; a kind's sections are parts of one stream through all windows."""
        s = Cursor(raw)
        size = s.base128()
        streams[kind] = streams[kind] or lzma.LZMADecompressor(lzma.FORMAT_XZ)
        try:
            out = streams[kind].decompress(s.take(s.left()), size)
        except (lzma.LZMAError, EOFError) as e:
            raise WireError("bad compression") from e
        if len(out) != size:
            raise WireError("section of another size")
        return out

    table, base, number = code_table(), 0, 0
    while c.left():
        if c.data[c.at : c.at + 4] == b"\xff" * 4 and not any(c.data[c.at + 4 : c.end]):
            break
        kind = c.u8()
        if kind & ~7 or kind & 3 == 3:
            raise WireError("unknown window bits")
        seg_len = seg_at = 0
        if kind & 3:
            seg_len, seg_at = c.base128(), c.base128()
        w = Cursor(c.take(c.base128()))
        size, packed = w.base128(), w.u8()
        lengths = [w.base128() for _ in range(3)]
        if kind & 4:
            p.check("target", f"adler32@{base}+{size}", w.be(4))
        raw = [w.take(n) for n in lengths]
        if w.left() or packed & ~7 or packed and compressor is None:
            raise WireError("window does not add up")
        adds, code, where = (Cursor(plain(x, k) if packed >> k & 1 else x) for k, x in enumerate(raw))
        p.meta.setdefault("windows", []).append((number, "source" if kind & 1 else "target" if kind & 2 else None, seg_at, seg_len, size))
        cache, out = Addresses(), 0
        while code.left():
            for what, n, mode in table[code.u8()]:
                if what == "noop":
                    continue
                n = n or code.base128()
                r = Record(what, base + out, n, window_no=number)
                if what == "add":
                    r.payload = adds.take(n)
                elif what == "run":
                    r.fill = adds.u8()
                else:
                    at = cache.decode(where, seg_len + out, mode)
                    if at < seg_len < at + n:
                        raise WireError("copy across the segment's end")
                    r.delta = mode
                    if at >= seg_len:
                        r.src_off, r.op = base + at - seg_len, "copy_own"
                    else:
                        r.src_off, r.op = seg_at + at, "copy" if kind & 1 else "copy_own"
                p.records.append(r)
                out += n
        if out != size or adds.left() or where.left():
            raise WireError("window does not make its size")
        base, number = base + size, number + 1
    p.target_size = base
    return p


DECODERS = {
    "IPS": ips, "IPS32": ips, "EBP": ips, "PPF1": ppf1, "PPF2": ppf2, "PPF3": ppf3, "PPF4": ppf4, "NINJA1": ninja1, "PMSR": pmsr,
    "APS-N64": aps_n64, "APS-GBA": aps_gba, "BPS": bps, "UPS": ups, "DPS": dps, "NINJA2": ninja2, "GDIFF": gdiff, "BSDiff": bsdiff,
    "VCDIFF": vcdiff, "xdelta1": xdelta1,
}


def is_dps(data: bytes) -> bool:
    """No magic: version, stability and records that end exactly at the end tell."""
    if len(data) < 198 or data[193] != 1 or data[192] > 1:
        return False
    at, n = 198, len(data)
    while at < n:
        if at + 9 > n:
            return False
        if data[at] == 0:
            at += 13
        elif data[at] == 1:
            at += 9 + int.from_bytes(data[at + 5 : at + 9], "little")
        else:
            return False
    return at == n


def looks_gba(data: bytes) -> bool:
    """The magic of one APS format is the start of the other's: whole blocks at multiples of 64 KiB tell."""
    body = len(data) - 12
    if body < 0 or body % 65544:
        return False
    return all(int.from_bytes(data[k : k + 4], "little") % 65536 == 0 for k in range(12, len(data), 65544))


def parse(fmt: str, data: bytes) -> Patch:
    if fmt not in DECODERS:
        raise WireError("unknown format")
    return DECODERS[fmt](data)
