"""Containers, detection, tables, chunked overlays, normalization, text, streaming."""

import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from deltaloom import queries
from deltaloom.functions import checksums, display, text
from deltaloom.operators import apply, create, diff, images, normalize, records, regions, verify
from deltaloom.plans import explain
from deltaloom.sources import containers, wire
from deltaloom.streaming import inbox

SOURCE = bytes(random.Random(1).randbytes(3000))
TARGET = SOURCE[:700] + b"edit" + SOURCE[704:2000] + bytes(50) + SOURCE[2050:] + b"more"


def zipped(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def packed_yay0(data):
    """An envelope of literals alone."""
    masks = b"".join(b"\xff\xff\xff\xff" for _ in range(-(-len(data) // 32)))
    return b"Yay0" + struct.pack(">III", len(data), 16 + len(masks), 16 + len(masks)) + masks + data


def test_unwrapping():
    patch = create.create("IPS", SOURCE, TARGET)
    assert containers.unwrap(zipped(("readme.txt", b"x"), ("a.ips", patch))) == patch
    assert containers.unwrap(packed_yay0(patch)) == patch
    linked = b"Yay0" + struct.pack(">III", 9, 20, 22) + struct.pack(">I", 0b110 << 29) + struct.pack(">H", 5 << 12 | 1) + b"ab"
    assert containers.yay0(linked) == b"ababababa"
    for bad in (zipped(("a.txt", b"")), zipped(("a", b"1"), ("b", b"2")), b"7z\xbc\xaf\x27\x1c", packed_yay0(packed_yay0(patch)), b"PK\3\4junk", b"Yay0" + bytes(5)):
        with pytest.raises(wire.WireError):
            containers.unwrap(bad)


def catalogue(spark):
    rows = [(k, create.create(f, SOURCE, TARGET)) for k, f in enumerate(create.ENCODERS) if f not in ("PPF1", "PPF2", "PPF3")]
    rows += [(100, b""), (101, b"PATCH"), (102, b"BPS1" + bytes(20)), (103, zipped(("p.bps", create.create("BPS", SOURCE, TARGET)))), (104, None)]
    return spark.createDataFrame([(k, bytearray(d) if d is not None else None) for k, d in rows], "patch_id long, content binary")


def test_tables_of_a_catalogue(spark):
    patches = catalogue(spark)
    heads = {r.patch_id: r for r in containers.headers(patches).collect()}
    for k, f in enumerate(create.ENCODERS):
        if k in heads:
            assert heads[k].format == f and heads[k].error is None
    assert heads[100].error and heads[104].error and heads[102].error and heads[103].format == "BPS"
    assert heads[101].advisories == ["truncated"] and heads[101].n_records == 0
    summed = {r.patch_id: r for r in explain.explain(patches).collect()}
    k = list(create.ENCODERS).index("IPS32")
    assert (summed[k].range_start, summed[k].range_end) == (700, len(TARGET))
    fast = patches.select("patch_id", containers.by_magic(F.col("content")).alias("f")).collect()
    assert {r.patch_id: r.f for r in fast}[k] == "IPS32"
    assert containers.envelope(containers.headers(patches)).filter("json LIKE '%BPS%'").count() == 3  # one of them refused


def test_verdicts_of_patches(spark):
    patches = catalogue(spark).filter("patch_id < 100")
    good = patches.select("patch_id", F.lit(SOURCE).alias("bytes"))
    bad = patches.select("patch_id", F.lit(SOURCE[::-1]).alias("bytes"))
    names = list(create.ENCODERS)
    one = {names[r.patch_id]: r for r in explain.verified(patches, good).collect()}
    two = {names[r.patch_id]: r for r in explain.verified(patches, bad).collect()}
    assert one["BPS"].verdict == "matches" and one["IPS"].verdict == "uncheckable" and one["NINJA1"].n_wrong == 0
    assert two["BPS"].verdict == "differs" and two["BPS"].refused_by == "crc32" and two["DPS"].verdict == "matches"


def test_bad_rows_do_not_fail_the_job(spark):
    rows = spark.createDataFrame([(1, "IPS", bytearray(b"PATCHEOF"), None), (2, "BPS", bytearray(b"nope"), bytearray(b"x")), (3, "none", None, None)], "id long, format string, patch binary, image binary")
    got = {r.id: (r.output, r.error is None) for r in apply.apply_patches(rows.filter("patch IS NOT NULL")).collect()}
    assert got == {1: (bytearray(b""), True), 2: (None, False)}


def chunks_of(spark, data, size, name="image_id"):
    return diff.chunked(spark.createDataFrame([(1, bytearray(data))], f"{name} long, b binary"), name, "b", size)


def test_chunked_overlay_is_last_writer_wins(spark):
    rnd = random.Random(4)
    base = bytes(rnd.randbytes(500))
    recs = [(1, rnd.randint(0, 470), k, bytearray(rnd.randbytes(rnd.randint(0, 60)))) for k in range(60)]
    want = bytearray(base)
    for _, off, _, p in recs:
        want[off : off + len(p)] = p[: max(0, 500 - off)]
    rows = spark.createDataFrame([r for r in recs if r[1] + len(r[3]) <= 500], "image_id long, off long, ordinal long, payload binary")
    want = bytearray(base)
    for _, off, _, p in recs:
        if off + len(p) <= 500:
            want[off : off + len(p)] = p
    out = apply.overlay_chunks(chunks_of(spark, base, 64), rows, 64).orderBy("chunk_no").collect()
    assert b"".join(bytes(r.bytes) for r in out) == bytes(want)


@pytest.mark.parametrize("size", [7, 64, 100_000])
def test_chunked_hunks_do_not_depend_on_the_chunks(spark, size):
    got = diff.hunks(chunks_of(spark, SOURCE, size, "pair_id"), chunks_of(spark, TARGET, size, "pair_id"), 5, chunk=size).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == create.hunks(SOURCE, TARGET, 5)


def test_overlaps_against_all_pairs(spark):
    rnd = random.Random(9)
    rows = [(p, k, rnd.randint(0, 50), rnd.randint(0, 12)) for p in range(20) for k in range(15)]
    got = {r.patch_id: r.n_pairs for r in records.overlaps(spark.createDataFrame(rows, "patch_id long, ordinal long, off long, len long")).collect()}
    for p in range(20):
        mine = [(o, o + n) for q, _, o, n in rows if q == p and n]
        assert got[p] == sum(a < d and c < b for i, (a, b) in enumerate(mine) for c, d in mine[:i])


def test_header_rescue(spark):
    widths = spark.createDataFrame([(16,), (512,)], "width long")
    rows = spark.createDataFrame([(1, 1000, 1512), (2, 1000, 984), (3, 5, 5), (4, 7, 9)], "image_id long, size long, wanted long")
    assert {r.image_id: (r.width, r.reframe) for r in verify.rescue(rows, widths).collect()} == {1: (512, "add"), 2: (16, "drop")}


def test_normal_forms_come_back():
    body = bytes(random.Random(2).randbytes(65536))
    for platform, data, shape in (
        ("nes", b"NES\x1a" + bytes(12) + body, "ines"), ("lynx", b"LYNX" + bytes(60) + body, "lynx"), ("snes", bytes(512) + body, "copier"),
        ("n64", b"\x37\x80\x40\x12" + body, "v64"), ("n64", b"\x40\x12\x37\x80" + body, "n64"), ("genesis", bytes(8) + b"\xaa\xbb" + bytes(502) + body, "smd"), ("gb", body, "as is"),
    ):
        n = normalize.normalize(data, platform)
        assert n.shape == shape and normalize.restore(n) == data
        assert n.shape not in ("v64", "n64") or n.data[:4] == b"\x80\x37\x12\x40"
    assert normalize.deinterleaved(normalize.interleaved(body)) == body


def test_normalized_table(spark):
    rows = spark.createDataFrame([(1, "nes", bytearray(b"NES\x1a" + bytes(12) + b"x")), (2, "gb", None)], "image_id long, platform string, bytes binary")
    assert [(r.shape, bytes(r.bytes)) for r in normalize.normalize_images(rows).collect()] == [("ines", b"x"), ("as is", b"")]


def test_texts(spark):
    assert text.fixed_field(b"name  \0junk") == ("name", 0) and text.fixed_field(bytes(8)) == (None, 0)
    assert text.fixed_field("日本".encode("shift_jis"), "cp932") == ("日本", 0) and text.fixed_field(b"a\xff")[1] == 1
    assert text.bounded("aéé", 4) == ("aé".encode(), True) and text.bounded("ab", 4) == (b"ab", False)
    assert text.encoding_name(" Latin-1 ") == "iso8859-1"
    df = spark.createDataFrame([(bytearray(b"x \0"),), (None,)], "b binary")
    assert [r.s.text for r in df.select(text.fixed_field_of(F.col("b")).alias("s")).collect()] == ["x", None]


def test_rendering(spark):
    df = spark.createDataFrame([(1234567, bytearray(b"A" * 65), ["a", "b", "c"]), (-1, bytearray(b"\x00"), []), (1, bytearray(b""), ["a"])], "n long, b binary, l array<string>")
    got = df.select(display.grouped(F.col("n")), display.hex_offset(F.col("n")), display.hex_dump(F.col("b")), display.printable(F.col("b")), display.prose(F.col("l")), display.plural(F.col("n"), "byte")).collect()
    assert tuple(got[0]) == ("1,234,567", "0x0012D687", "41" * 64 + "...", True, "a, b and c", "1,234,567 bytes")
    assert tuple(got[1])[1:5] == ("-0x00000001", "00", False, "") and tuple(got[2])[4:] == ("a", "1 byte")


def test_checksums(spark):
    assert checksums.crc16(b"123456789") == 0x29B1 and checksums.adler32(b"abc") == 0x024D0127
    df = spark.createDataFrame([(bytearray(b"123456789"),)], "b binary")
    assert df.select(checksums.crc16_of("b"), checksums.digests(F.col("b"))[1]).first()[:] == (0x29B1, "cbf43926")


def test_percent_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(1, 2000), (3, 2000), (1, 3)], "a long, b long")
    assert [float(r[0]) for r in df.select(regions.percent(F.col("a"), F.col("b"))).collect()] == [0.0, 0.2, 33.3]


def test_neighbours_pair_each_image_with_the_one_before(spark):
    rows = spark.createDataFrame([(k * 3, f"t{k}") for k in range(50)], "doc_id long, text string")
    got = sorted((r.pair_id, bytes(r.source), bytes(r.target)) for r in images.neighbours(images.documents(rows)).collect())
    assert got == [(k * 3, f"t{k - 1}".encode(), f"t{k}".encode()) for k in range(1, 50)]


def test_conversion_by_output(spark):
    patches = spark.createDataFrame([(1, bytearray(create.create("IPS", SOURCE, TARGET)))], "patch_id long, content binary")
    made = explain.converted(patches, spark.createDataFrame([(1, bytearray(SOURCE))], "patch_id long, bytes binary"), "GDIFF").first()
    assert apply.run(wire.parse("GDIFF", bytes(made.patch)), SOURCE) == TARGET


def test_inbox(spark, tmp_path):
    box, out = tmp_path / "in", tmp_path / "out"
    box.mkdir()
    for n, f in enumerate(("IPS", "BPS")):
        (box / f"{n}.bin").write_bytes(create.create(f, SOURCE, TARGET))
    (box / "bad").write_bytes(b"?")
    go = lambda: inbox.catalogue(spark, f"file://{box}", f"file://{out}", f"file://{tmp_path}/state")
    go()
    (box / "late.bin").write_bytes(create.create("UPS", SOURCE, TARGET))
    go()
    heads = spark.read.parquet(f"file://{out}/headers").collect()
    assert sorted(r.format or "" for r in heads) == ["", "BPS", "IPS", "UPS"]
    assert spark.read.parquet(f"file://{out}/records").select("patch_id").distinct().count() == 3


def test_hunks_are_cut_without_copies_of_their_images(spark, sf):
    pairs = queries.edited_documents(spark, sf)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    some = spark.createDataFrame([(1, b"abcdefgh", b"aBCdefGH"), (2, b"same", b"same")], "pair_id long, source binary, target binary")
    hunks = spark.createDataFrame([(1, 6, 8), (1, 1, 3)], "pair_id long, start long, end long")
    got = queries.cut_hunks(hunks, some)
    rows = [(r.image_id, r.off, r.ordinal, bytes(r.old), bytes(r.new)) for r in got.orderBy("off").collect()]
    assert rows == [(1, 1, 1, b"bc", b"BC"), (1, 6, 2, b"gh", b"GH")]
    plan = got.select(queries.mask(F.col("old"), F.col("new")))._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Arrow" in x and "source" in x]


def test_gaps_are_closed_inside_chunks(spark):
    """What leaves a chunk is a row for each hunk, not for each run of bytes."""
    images = spark.createDataFrame([(1, bytes(4000), b"\1\0\0" * 1000 + b"\0" * 7 + b"\1" * 993)], "pair_id long, source binary, target binary")
    a, b = (diff.chunked(images, "pair_id", c, 1024) for c in ("source", "target"))
    assert diff.changed_runs(a, b, chunk=1024).count() > 1000
    assert diff.changed_runs(a, b, chunk=1024, gap=5).count() == 5
    assert sorted(map(tuple, diff.hunks(a, b, 5, chunk=1024).collect())) == [(1, 0, 2998), (1, 3007, 4000)]


def test_masks_of_unequal_columns(spark):
    rows = [(b"abc", b"ABC"), (b"", b"xy"), (b"abcd", b"ab"), (b"q", b"")]
    df = spark.createDataFrame(rows, "a binary, b binary")
    got = [bytes(r[0]) for r in df.select(queries.mask(F.col("a"), F.col("b"))).collect()]
    assert got == [create.masked(a, b, 0, len(b)) for a, b in rows]
