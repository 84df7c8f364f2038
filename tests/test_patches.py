"""Every format: created, parsed and applied; undone where it can be; cut short at any place."""

import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deltaloom.operators.apply import run, undo
from deltaloom.operators.create import ENCODERS, create, create_patches, format_of
from deltaloom.sources import containers
from deltaloom.sources.wire import DECODERS, WireError, is_dps, parse

blobs = st.binary(max_size=600)


@st.composite
def pairs(draw):
    """Two images: unrelated, or one an edit of the other."""
    source = draw(blobs) * draw(st.sampled_from([1, 1, 3, 80]))
    if draw(st.booleans()):
        return source, draw(blobs)
    target = bytearray(source)
    for _ in range(draw(st.integers(0, 5))):
        at = draw(st.integers(0, len(target)))
        kind = draw(st.integers(0, 3))
        if kind == 0:
            target[at : at + 30] = draw(st.binary(max_size=40))
        elif kind == 1:
            target[at:at] = bytes([draw(st.integers(0, 255))]) * draw(st.integers(1, 400))
        elif kind == 2:
            target[at:at] = target[: draw(st.integers(0, 200))]
        else:
            del target[at : at + draw(st.integers(0, 50))]
    return source, bytes(target)


def allowed(fmt, s, t):
    if fmt in ("PPF1", "PPF3"):
        return len(s) == len(t)
    if fmt in ("IPS32", "EBP", "PPF4", "NINJA1", "PMSR"):
        return len(t) >= len(s)
    if fmt == "PPF2":
        return len(t) >= len(s) >= 0x9320 + 1024
    return fmt != "UPS" or not any(s[len(t) :])


@pytest.mark.parametrize("fmt", list(ENCODERS))
@settings(max_examples=60, deadline=None)
@given(pairs())
def test_round_trip(fmt, pair):
    s, t = pair
    if fmt in ("PPF1", "PPF3"):
        n = min(len(s), len(t))
        s, t = s[:n], t[:n]
    if fmt == "PPF2":
        s, t = s.ljust(40_000, b"s"), t.ljust(40_100, b"t")
    if not allowed(fmt, s, t):
        if fmt == "IPS" or len(t) < len(s):
            with pytest.raises(WireError):
                create(fmt, s, t)
        return
    patch = parse(fmt, create(fmt, s, t))
    assert run(patch, s) == t
    if fmt in ("UPS", "NINJA2", "PPF3"):
        assert undo(patch, t) == s
    elif fmt != "EBP":
        with pytest.raises(WireError):
            undo(patch, t)


@pytest.mark.parametrize("fmt", list(ENCODERS))
@settings(max_examples=30, deadline=None)
@given(pairs(), st.data())
def test_truncation_never_crashes(fmt, pair, data):
    s, t = pair
    n = min(len(s), len(t))
    s, t = (s[:n], t[:n]) if fmt in ("PPF1", "PPF3") else (s, s + t)
    try:
        whole = create(fmt, s, t)
    except WireError:
        return
    cut = whole[: data.draw(st.integers(0, len(whole)))]
    try:
        run(parse(fmt, cut), s)
    except (WireError, IndexError, ValueError):
        pass


@pytest.mark.parametrize("fmt", list(ENCODERS))
def test_identity_is_a_no_op(fmt):
    s = bytes(range(256)) * 160
    assert run(parse(fmt, create(fmt, s, s)), s) == s


def test_wire_vectors():
    """Bytes put together by hand, never by the encoders."""
    assert run(parse("IPS", b"PATCH\0\0\1\0\2hi\0\0\5\0\0\0\3zEOF"), b"......") == b".hi..zzz"
    assert run(parse("IPS", b"PATCH\0\0\1\0\2hiEOF\0\0\2"), b"......") == b".h"
    assert run(parse("IPS", b"PATCH\0\0\1\0\2hi"), b"....") == b".hi."  # ends early: what was read counts
    assert run(parse("IPS32", b"IPS32\0\0\0\2\0\1xEEOF"), b"....") == b"..x."
    assert parse("IPS", b'PATCHEOF{"Title":"t"}').meta == {"title": "t"}
    assert run(parse("PMSR", b"PMSR\0\0\0\1\0\0\0\1\0\0\0\2ab"), b"...") == b".ab"
    assert run(parse("GDIFF", b"\xd1\xff\xd1\xff\4\2ab\xf9\0\1\3\0"), b"wxyz") == b"abxyz"
    body = b"BPS1\x80\x85\x80" + b"\x81" + b"a" + b"\x8f\x80"  # one literal, then four bytes from its place
    body += zlib.crc32(b"").to_bytes(4, "little") + zlib.crc32(b"aaaaa").to_bytes(4, "little")
    assert run(parse("BPS", body + zlib.crc32(body).to_bytes(4, "little")), b"") == b"aaaaa"
    # a copy of the segment, a literal, and a copy that reaches its own output
    window = b"\1\4\0" + b"\x0b" + b"\x0b\0\1\3\2" + b"z" + b"\x14\2\x16" + b"\0\4"
    p = parse("VCDIFF", b"\xd6\xc3\xc4\0\0" + window)
    assert [(r.op, r.len, r.src_off) for r in p.records] == [("copy", 4, 0), ("add", 1, None), ("copy_own", 6, 0)]
    assert run(p, b"abcd") == b"abcdzabcdza"
    with pytest.raises(WireError):
        parse("VCDIFF", b"\xd6\xc3\xc4\0\0" + window[:-1] + b"\x0b")  # from where nothing is yet


def test_refusals():
    for fmt, data in (
        ("IPS", b"PATCHEOFxxxx"), ("PPF4", b"PPF4" + b"40\0" + bytes(50) + b"\1\0\0\0"), ("UPS", b"UPS1" + bytes(12)), ("BPS", b"BPS1"),
        ("PMSR", b"PMSR\0\0\0\1\xff\0\0\0\0\0\0\0"), ("NINJA1", b"NINJA1B" + bytes(41)), ("NINJA2", b"NINJA2\2" + bytes(3000)), ("xdelta1", b"%XDZ003%" + bytes(60)),
        ("BSDiff", b"BSDIFF40" + b"\xff" * 24), ("DPS", bytes(198)), ("GDIFF", b"\xd1\xff\xd1\xff\4\5ab"), ("VCDIFF", b"\xd6\xc3\xc4\0\2"), ("nope", b""),
    ):
        with pytest.raises(WireError):
            parse(fmt, data)


def test_names_of_formats():
    assert format_of(None) == "BPS" and format_of("ips") == "IPS" and format_of("a/b.UPS") == "UPS" and format_of("x.rup") == "NINJA2"
    with pytest.raises(WireError):
        format_of("x.txt")
    assert is_dps(create("DPS", b"abc", b"abd")) and not is_dps(create("DPS", b"abc", b"abd")[:-1])
    assert set(ENCODERS) == set(DECODERS)


def test_numbers_beyond_a_format_are_rows(spark):
    """A pair too large for IPS is a row with its error, not a failed job."""
    rows = [(1, bytes(17 << 20), bytes((16 << 20) + 5)), (2, b"abc", b"abd")]
    made = create_patches(spark.createDataFrame(rows, "id long, source binary, target binary"), "IPS").collect()
    assert [(r.id, r.patch is None, r.error) for r in made] == [(1, True, "the target is beyond the format"), (2, False, None)]


def ppf3(*records):
    head = b"PPF30" + bytes([2]) + b" " * 50 + bytes([0, 0, 1, 0])
    return head + b"".join(struct.pack("<qB", off, len(new)) + new + old for off, new, old in records)


def test_undo_of_ppf3_refuses_what_does_not_fit_and_goes_forward():
    back = lambda *records: undo(parse("PPF3", ppf3(*records)), b"0123456789")
    assert back((2, b"xx", b"AB")) == b"01AB456789"
    assert back((2, b"xx", b"AB"), (3, b"yy", b"CD")) == b"01ACD56789"
    for bad in ((-3, b"xx", b"AB"), (9, b"xx", b"AB")):
        with pytest.raises(WireError):
            back(bad)


def test_an_envelope_that_copies_past_its_size_is_refused():
    data = b"Yay0" + struct.pack(">III", 3, 20, 22) + struct.pack(">I", 0x80000000) + struct.pack(">H", 0xE000) + b"a"
    with pytest.raises(WireError):
        containers.yay0(data)
    assert containers.yay0(data.replace(struct.pack(">III", 3, 20, 22), struct.pack(">III", 17, 20, 22))) == b"a" * 17


def test_crc16_by_its_definition():
    import binascii

    from deltaloom.functions import checksums

    for data in (b"", b"123456789", bytes(range(256)) * 9):
        c = 0xFFFF
        for b in data:
            c ^= b << 8
            for _ in range(8):
                c = (c << 1 ^ 0x1021 if c & 0x8000 else c << 1) & 0xFFFF
        assert checksums.crc16(data) == c == binascii.crc_hqx(data, 0xFFFF)


def test_xdelta1_of_compressed_files_is_refused():
    made = create("xdelta1", b"hello there, world " * 20, b"hello where, world " * 20)
    flags = int.from_bytes(made[8:12], "big")
    for bit, said in ((2, "the source was"), (4, "the target was"), (6, "both were")):
        with pytest.raises(WireError, match=said):
            run(parse("xdelta1", made[:8] + (flags | bit).to_bytes(4, "big") + made[12:]), b"hello there, world " * 20)
