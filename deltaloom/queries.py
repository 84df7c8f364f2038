"""Queries over the driver's tables, each with its SQL equivalent.

Stand-ins: an order's line items are the records of a patch (offset 16 * part key, length the quantity, the
return flag tells the kind), documents are byte images, and a document and the one before it are a pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import convert, cursors, records, regions, verify
from .plans import dims
from .plans.staging import dropped, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().startswith("WITH RECURSIVE") else "WITH " + RECORDS + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
RECORDS = f"""r AS (
  SELECT l_orderkey AS patch_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) - 1 AS ordinal,
         l_partkey * 16 AS off, CAST(l_quantity AS BIGINT) AS len, l_suppkey AS supp, l_linenumber AS line,
         CASE l_returnflag WHEN 'A' THEN 'fill' WHEN 'R' THEN 'copy' ELSE 'write' END AS kind
  FROM lineitem)
"""


def record_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch_id, ordinal, off, len, supp, line, kind: the stand-in records of all orders."""
    rows = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    return rows.select(
        F.col("l_orderkey").alias("patch_id"),
        (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)) - 1).cast("long").alias("ordinal"),
        (F.col("l_partkey") * 16).alias("off"),
        F.col("l_quantity").cast("long").alias("len"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_linenumber").alias("line"),
        F.when(flag == "A", "fill").when(flag == "R", "copy").otherwise("write").alias("kind"),
    )


def image_size(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Records with the stand-in size of their image: the order's price, in bytes."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("patch_id"), F.col("o_totalprice").cast("long").alias("size"))
    return rows.join(orders, "patch_id")


SIZED = ", s AS (SELECT r.*, CAST(trunc(o_totalprice) AS BIGINT) AS size FROM r JOIN orders ON o_orderkey = patch_id)\n"


@query("""SELECT patch_id, count(*) AS n_regions, sum(len)::BIGINT AS total_modified,
  count(*) FILTER (kind = 'write') AS n_write, count(*) FILTER (kind = 'fill') AS n_fill, count(*) FILTER (kind = 'copy') AS n_copy,
  count(*) FILTER (kind = 'xor') AS n_xor, count(*) FILTER (kind = 'meta') AS n_meta,
  min(off) FILTER (len <> 0) AS range_start, max(off + len) FILTER (len <> 0) AS range_end, min(len) AS min_size, max(len) AS max_size,
  list_sort(list(len))[count(*) // 2 + 1] AS median_size, (sum(len) // count(*))::BIGINT AS mean_size, min(len) = max(len) AS uniform
  FROM r GROUP BY patch_id""")
def region_summary(spark, sf_dir):
    return regions.summary(record_view(spark, sf_dir))


HISTOGRAM = """, b AS (SELECT *, off + len AS e FROM r WHERE len <> 0),
  w AS (SELECT patch_id, min(off) AS lo, greatest(1, (max(e) - min(off) + 55) // 56) AS width FROM b GROUP BY patch_id),
  c AS (SELECT patch_id, width, len, (off - lo) // width AS first, unnest(generate_series((off - lo) // width, (e - 1 - lo) // width)) AS bucket FROM b JOIN w USING (patch_id)),
  h AS (SELECT patch_id, bucket::BIGINT AS bucket, max(width) AS width, count(*) FILTER (bucket = first) AS n_records, coalesce(sum(len) FILTER (bucket = first), 0)::BIGINT AS n_bytes FROM c GROUP BY patch_id, bucket)
"""


@query(HISTOGRAM + "SELECT * FROM h")
def region_histogram(spark, sf_dir):
    return regions.histogram(record_view(spark, sf_dir))


@query(HISTOGRAM + """, f AS (SELECT *, CASE WHEN bucket - lag(bucket) OVER (PARTITION BY patch_id ORDER BY bucket) > 1 THEN 1 ELSE 0 END AS fresh FROM h),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY patch_id ORDER BY bucket) AS run FROM f),
  o AS (SELECT patch_id, run::BIGINT AS run, min(bucket) AS first, max(bucket) AS last, sum(n_records)::BIGINT AS n_records, sum(n_bytes)::BIGINT AS n_bytes FROM g GROUP BY ALL),
  t AS (SELECT *, n_bytes * 1000 AS num, sum(n_bytes) OVER (PARTITION BY patch_id) AS den FROM o)
  SELECT patch_id, run, first, last, n_records, n_bytes,
   (num // den + CASE WHEN 2 * (num % den) > den OR (2 * (num % den) = den AND (num // den) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 10 AS percent FROM t""")
def occupied_runs(spark, sf_dir):
    return regions.occupied_runs(regions.histogram(record_view(spark, sf_dir)))


@query("SELECT kind, count(*) AS n_records, sum(len)::BIGINT AS n_bytes, count(DISTINCT patch_id) AS n_patches FROM r GROUP BY kind")
def kind_tally(spark, sf_dir):
    return regions.tally(record_view(spark, sf_dir))


@query(""", p AS (SELECT doc_id AS patch_id, octet_length(encode(text))::BIGINT AS target_size, lag(octet_length(encode(text))) OVER (ORDER BY doc_id)::BIGINT AS source_size FROM documents)
  SELECT patch_id, source_size, target_size, target_size - source_size AS change, CASE WHEN target_size > source_size THEN 'grows' WHEN target_size < source_size THEN 'shrinks' ELSE 'keeps' END AS sense
  FROM p WHERE source_size IS NOT NULL""")
def size_change(spark, sf_dir):
    from .operators import images

    pairs = images.neighbours(images.documents(table(spark, sf_dir, "documents")))
    return regions.size_change(
        pairs.select(F.col("pair_id").alias("patch_id"), F.octet_length("source").cast("long").alias("source_size"), F.octet_length("target").cast("long").alias("target_size"))
    )


@query("""SELECT a.patch_id, count(b.patch_id)::BIGINT AS n_pairs FROM r a LEFT JOIN r b ON a.patch_id = b.patch_id AND a.ordinal < b.ordinal AND a.off < b.off + b.len AND b.off < a.off + a.len
  GROUP BY a.patch_id""")
def overlap_pairs(spark, sf_dir):
    return records.overlaps(record_view(spark, sf_dir)).select("patch_id", "n_pairs")


@query(""", l AS (SELECT *, lag(off) OVER (PARTITION BY patch_id ORDER BY ordinal) AS before FROM r)
  SELECT patch_id, min(ordinal) AS first_ordinal, count(*) AS n_unsorted FROM l WHERE before > off GROUP BY patch_id""")
def unsorted_records(spark, sf_dir):
    return records.unsorted(record_view(spark, sf_dir))


CLIP = SIZED + """, c AS (SELECT *, CASE WHEN len <= size - off THEN 'fits' WHEN off < size THEN 'partly' ELSE 'past' END AS place, greatest(0, least(len, size - off)) AS kept FROM s)"""


@query(CLIP + """SELECT patch_id, count(*) FILTER (place = 'partly') AS n_partly, count(*) FILTER (place = 'past') AS n_past,
  coalesce(min(ordinal) FILTER (place <> 'fits'), -1) AS first_ordinal, sum(len - kept)::BIGINT AS lost_bytes FROM c GROUP BY patch_id""")
def clip_summary(spark, sf_dir):
    found = records.clip_summary(records.clip(image_size(spark, sf_dir, record_view(spark, sf_dir)), "size"))
    return found.withColumn("first_ordinal", F.coalesce("first_ordinal", F.lit(-1).cast("long")))


@query(SIZED + """SELECT patch_id, max(size) AS source_size, greatest(max(size), coalesce(max(off + len) FILTER (len > 0), 0)) AS output_size,
  CASE WHEN max(line) * 30000 < max(off + len) THEN 'honored' WHEN max(line) * 30000 = max(off + len) THEN 'no-op' ELSE 'ignored' END AS truncation FROM s GROUP BY patch_id""")
def output_size(spark, sf_dir):
    rows = image_size(spark, sf_dir, record_view(spark, sf_dir))
    natural = rows.groupBy("patch_id").agg(F.max(F.col("off") + F.col("len")).alias("n"), (F.max("line") * 30000).alias("declared"))
    marks = natural.select("patch_id", records.truncation(F.col("declared"), F.col("n")).alias("truncation"))
    return records.output_size(rows, "size").join(marks, "patch_id")


@query(SIZED + """SELECT patch_id, ordinal, off >= 0 AND len >= 0 AND off <= size AND len <= size - off AS fits,
  CASE WHEN off < 0 THEN 'negative' WHEN off > 1048575 THEN 'too large' ELSE 'ok' END AS wire, (size & 4095) = 512 AS headed,
  CASE WHEN supp * 40 >= len THEN 'disjoint' WHEN supp * 40 = 1 THEN 'run' ELSE 'overlap' END AS copy_class FROM s""")
def record_classes(spark, sf_dir):
    rows = image_size(spark, sf_dir, record_view(spark, sf_dir))
    off, length, size = F.col("off"), F.col("len"), F.col("size")
    return rows.select(
        "patch_id",
        "ordinal",
        records.fits_within(off, length, size).alias("fits"),
        records.wire_offset(off, F.lit(0xFFFFF)).alias("wire"),
        records.copier_headed(size).alias("headed"),
        records.copy_class(off, off - F.col("supp") * 40, length).alias("copy_class"),
    )


@query(SIZED + """, b AS (SELECT *, CASE WHEN off + len > size THEN 'past the ceiling' END AS why FROM s)
  SELECT patch_id, min(ordinal) AS first_ordinal, arg_min(why, ordinal) AS why, count(*) AS n_bad FROM b WHERE why IS NOT NULL GROUP BY patch_id""")
def record_refusals(spark, sf_dir):
    return records.refusals(image_size(spark, sf_dir, record_view(spark, sf_dir)), "size")


@query(""", p AS (SELECT patch_id, ordinal, off, len, unnest(generate_series(0, len - 1, 16)) AS skip FROM r WHERE len > 0)
  SELECT patch_id, ordinal, off + skip AS off, least(16, len - skip) AS len FROM p""")
def split_records(spark, sf_dir):
    return records.split(record_view(spark, sf_dir), 16)


@query(SIZED + """, e AS (SELECT *, greatest(0, least(len, size - off)) AS edge FROM s)
  SELECT patch_id, ordinal, 'replace' AS phase, off, edge AS len FROM e WHERE edge > 0
  UNION ALL SELECT patch_id, ordinal, 'append', off + edge, len - edge FROM e WHERE edge < len""")
def phase_split(spark, sf_dir):
    return records.phases(image_size(spark, sf_dir, record_view(spark, sf_dir)), "size")


@query(SIZED + """, e AS (SELECT *, greatest(0, least(len, size - off)) AS have FROM s)
  SELECT patch_id, ordinal, have AS from_source, len - have AS zeros, CASE WHEN have = len THEN 'inside' WHEN have > 0 THEN 'straddles' ELSE 'past' END AS place FROM e""")
def source_parts(spark, sf_dir):
    rows = records.source_part(image_size(spark, sf_dir, record_view(spark, sf_dir)), "size")
    return rows.select("patch_id", "ordinal", "from_source", "zeros", F.col("where").alias("place"))


@query("""SELECT o_orderkey AS patch_id, f.f AS format, CASE WHEN t = s THEN TRUE WHEN f.f IN ('PPF1', 'PPF3') THEN FALSE WHEN f.f = 'APS-N64' THEN TRUE
  WHEN f.f = 'IPS' THEN CASE WHEN t > s THEN t <= 16842750 ELSE t <= 16777215 END ELSE t > s END AS allowed
  FROM (SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS s, o_custkey * 128 AS t FROM orders), (SELECT unnest(['IPS','IPS32','EBP','PPF1','PPF2','PPF3','PPF4','NINJA1','PMSR','APS-N64']) AS f) f""")
def size_gates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    direct = dims.formats(spark).filter("kind = 'direct'").select("format")
    both = orders.select("o_orderkey", F.col("o_totalprice").cast("long").alias("s"), (F.col("o_custkey") * 128).alias("t")).crossJoin(F.broadcast(direct))
    return both.select(F.col("o_orderkey").alias("patch_id"), "format", records.size_gate(F.col("format"), F.col("s"), F.col("t")).alias("allowed"))


@query(""", o AS (SELECT DISTINCT patch_id, ordinal * 1000 AS off, len, ordinal FROM r), l AS (
  SELECT *, coalesce(lag(off + len) OVER (PARTITION BY patch_id ORDER BY off, ordinal), 0) AS start FROM o)
  SELECT patch_id, start, off AS "end" FROM l WHERE off > start UNION ALL
  SELECT patch_id, max(off + len), 10000 FROM o GROUP BY patch_id HAVING max(off + len) < 10000""")
def gap_records(spark, sf_dir):
    rows = record_view(spark, sf_dir).select("patch_id", "ordinal", (F.col("ordinal") * 1000).alias("off"), "len", F.lit(10000).cast("long").alias("size"))
    return records.gaps(rows, "size")


def before_sql(value: str, extra: str = "") -> str:
    return f"coalesce(sum({value}) OVER (PARTITION BY patch_id{extra} ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT"


@query(f"SELECT patch_id, ordinal, {before_sql('len')} AS out, {before_sql('supp + len + 1')} + supp AS block_out FROM r")
def output_cursors(spark, sf_dir):
    rows = cursors.output(record_view(spark, sf_dir)).withColumnRenamed("out", "o")
    rows = cursors.output(rows, "supp", 1)
    return rows.select("patch_id", "ordinal", F.col("o").alias("out"), F.col("out").alias("block_out"))


COPIES = ", c AS (SELECT patch_id, ordinal, len, supp - 5 AS delta, CASE kind WHEN 'fill' THEN 'source_copy' WHEN 'copy' THEN 'target_copy' ELSE 'target_read' END AS op FROM r)"


def copy_view(spark, sf_dir):
    op = F.when(F.col("kind") == "fill", "source_copy").when(F.col("kind") == "copy", "target_copy").otherwise("target_read")
    return record_view(spark, sf_dir).select("patch_id", "ordinal", "len", (F.col("supp") - 5).alias("delta"), op.alias("op"))


@query(COPIES + f""", p AS (SELECT *, {before_sql('len')} AS out, CASE op
   WHEN 'source_copy' THEN {before_sql("CASE WHEN op = 'source_copy' THEN delta + len ELSE 0 END")} + delta
   WHEN 'target_copy' THEN {before_sql("CASE WHEN op = 'target_copy' THEN delta + len ELSE 0 END")} + delta END AS reads FROM c)
  SELECT patch_id, ordinal, op, out, reads::VARCHAR AS reads, CASE WHEN reads < 0 THEN 'underflow' WHEN op = 'target_copy' AND reads >= out THEN 'ahead of output' END AS fault FROM p""")
def copy_cursors(spark, sf_dir):
    return cursors.copies(copy_view(spark, sf_dir)).select("patch_id", "ordinal", "op", "out", F.col("reads").cast("string").alias("reads"), "fault")


@query(f"SELECT patch_id, ordinal, {before_sql('len')} AS diff_at, {before_sql('supp')} AS extra_at, {before_sql('len + line - 3')} AS source_at, {before_sql('len + supp')} AS out FROM r")
def triple_cursors(spark, sf_dir):
    rows = record_view(spark, sf_dir).select("patch_id", "ordinal", F.col("len").alias("add"), F.col("supp").alias("copy"), (F.col("line") - 3).cast("long").alias("seek"))
    return cursors.triples(rows).select("patch_id", "ordinal", "diff_at", "extra_at", "source_at", "out")


@query(f"""SELECT patch_id, ordinal, kind AS source, CASE WHEN kind <> 'write' THEN {before_sql('len', ', kind')} ELSE off END AS "at" FROM r""")
def sequential_offsets(spark, sf_dir):
    rows = record_view(spark, sf_dir).withColumn("source", F.col("kind")).withColumn("sequential", F.col("kind") != "write")
    return cursors.sequential(rows).select("patch_id", "ordinal", "source", "at")


FILE_WINDOWS = ", w AS (SELECT patch_id, ordinal AS window_no, CASE WHEN line % 3 = 0 THEN 64 ELSE len END AS target_size, CASE kind WHEN 'fill' THEN 'source' WHEN 'copy' THEN 'target' END AS origin FROM r)"


def window_view(spark, sf_dir):
    origin = F.when(F.col("kind") == "fill", "source").when(F.col("kind") == "copy", "target")
    size = F.when(F.col("line") % 3 == 0, 64).otherwise(F.col("len"))
    return record_view(spark, sf_dir).select("patch_id", F.col("ordinal").alias("window_no"), size.cast("long").alias("target_size"), origin.alias("origin"))


@query(FILE_WINDOWS + "SELECT patch_id, window_no, coalesce(sum(target_size) OVER (PARTITION BY patch_id ORDER BY window_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM w")
def window_bases(spark, sf_dir):
    return cursors.windows(window_view(spark, sf_dir)).select("patch_id", "window_no", "base")


@query(FILE_WINDOWS + """, l AS (SELECT *, max(window_no) OVER (PARTITION BY patch_id) AS last FROM w)
  SELECT patch_id, count(*) AS n_windows, count(*) FILTER (origin = 'source') AS n_from_source, count(*) FILTER (origin = 'target') AS n_from_target,
  sum(target_size)::BIGINT AS target_size, count(DISTINCT target_size) FILTER (window_no < last) <= 1 AS even FROM l GROUP BY patch_id""")
def window_rollup(spark, sf_dir):
    return cursors.even(window_view(spark, sf_dir))


@query(SIZED + f""", p AS (SELECT *, CASE WHEN kind = 'write' THEN 'append' ELSE 'replace' END AS phase FROM s)
  SELECT patch_id, ordinal, CASE WHEN phase = 'append' THEN size + {before_sql("CASE WHEN phase = 'append' THEN len ELSE 0 END")} ELSE off END AS "at" FROM p""")
def append_offsets(spark, sf_dir):
    rows = image_size(spark, sf_dir, record_view(spark, sf_dir)).withColumn("phase", F.when(F.col("kind") == "write", "append").otherwise("replace"))
    return cursors.appended(rows, "size").select("patch_id", "ordinal", "at")


@query(""", l AS (SELECT kind AS op, lead(kind) OVER (PARTITION BY patch_id ORDER BY ordinal) AS "then" FROM r)
  SELECT op, "then", count(*) AS n FROM l WHERE "then" IS NOT NULL GROUP BY ALL""")
def opcode_pairs(spark, sf_dir):
    return cursors.opcode_pairs(record_view(spark, sf_dir).withColumn("op", F.col("kind")))


VERIFY = """, c AS (SELECT patch_id, 'source' AS side, concat('check', line) AS kind, ordinal AS position, len % 5 AS expected, CASE WHEN line % 2 = 1 THEN 'fatal' ELSE 'advisory' END AS severity FROM r WHERE kind <> 'write'),
  m AS (SELECT DISTINCT patch_id, 'source' AS side, concat('check', line) AS kind, supp % 5 AS actual FROM r WHERE line < 6),
  w AS (SELECT c.*, actual, CASE WHEN actual IS NULL THEN 'unmeasured' WHEN actual = expected THEN 'held' ELSE 'mismatched' END AS state FROM c LEFT JOIN m USING (patch_id, side, kind)),
  n AS (SELECT patch_id, count(*) FILTER (state <> 'unmeasured') AS n_checks, count(*) FILTER (state = 'mismatched') AS n_wrong,
        arg_min(kind, position) FILTER (state = 'mismatched' AND severity = 'fatal') AS refused_by FROM w GROUP BY patch_id)
  SELECT o_orderkey AS patch_id, coalesce(n_checks, 0) AS n_checks, coalesce(n_wrong, 0) AS n_wrong,
  CASE WHEN n_wrong > 0 THEN 'differs' WHEN n_checks > 0 THEN 'matches' ELSE 'uncheckable' END AS verdict, refused_by FROM orders LEFT JOIN n ON patch_id = o_orderkey"""


@query(VERIFY)
def verdicts(spark, sf_dir):
    rows = record_view(spark, sf_dir).withColumn("side", F.lit("source")).withColumn("name", F.concat(F.lit("check"), "line"))
    checks = rows.filter("kind <> 'write'").select(
        "patch_id", "side", F.col("name").alias("kind"), F.col("ordinal").alias("position"), (F.col("len") % 5).alias("expected"),
        F.when(F.col("line") % 2 == 1, "fatal").otherwise("advisory").alias("severity"),
    )
    measured = rows.filter("line < 6").select("patch_id", "side", F.col("name").alias("kind"), (F.col("supp") % 5).alias("actual")).distinct()
    patches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("patch_id"))
    return verify.verdicts(patches, verify.weigh(checks, measured))


@query(""", w AS (SELECT unnest([16, 64, 128, 512]) AS width), i AS (SELECT o_orderkey AS image_id, o_custkey AS size, o_custkey + CASE o_orderkey % 5 WHEN 0 THEN 16 WHEN 1 THEN -64 WHEN 2 THEN 512 WHEN 3 THEN 7 ELSE 0 END AS wanted FROM orders),
  f AS (SELECT image_id, width, sense FROM i, w, (SELECT unnest([-1, 1]) AS sense) WHERE size <> wanted AND size + sense * width = wanted)
  SELECT image_id, count(*) AS n_ways, min(width)::BIGINT AS width, CASE WHEN count(*) = 1 THEN CASE WHEN min(sense) > 0 THEN 'add' ELSE 'drop' END END AS reframe FROM f GROUP BY image_id""")
def header_rescue(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    by = F.when(k == 0, 16).when(k == 1, -64).when(k == 2, 512).when(k == 3, 7).otherwise(0)
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("size"), (F.col("o_custkey") + by).alias("wanted"))
    return verify.rescue(images, dims.header_widths(spark))


def sql_list(rows) -> str:
    return "[" + ", ".join(f"'{x}'" for x in rows) + "]"


FIELDS = ["truncation", "description", "ebp_meta", "diz", "validation", "source_size", "undo", "destination_size", "rom_type", "image_type"]
HAVE = f"""h AS (SELECT o_orderkey AS patch_id, list_filter({sql_list(FIELDS)}, lambda x: (o_orderkey // (list_position({sql_list(FIELDS)}, x)::BIGINT * 3)) % 4 = 0) AS have FROM orders)"""
CONTRACT_ROWS = ", ".join(f"('{t}', {sql_list(a)}::VARCHAR[], {sql_list(b)}::VARCHAR[])" for t, a, b in dims.CONTRACTS)


def have(spark, sf_dir):
    chosen = [F.when(F.expr(f"(o_orderkey div {3 * (k + 1)}) % 4 = 0"), F.lit(f)) for k, f in enumerate(FIELDS)]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("patch_id"), F.array_compact(F.array(*chosen)).alias("have"))


@query(f""", {HAVE}, k AS (SELECT * FROM (VALUES {CONTRACT_ROWS}) v(target, required, accepted)), b AS (
  SELECT *, list_sort(list_filter(have, lambda x: NOT list_contains(required, x) AND NOT list_contains(accepted, x))) AS dropped, list_sort(list_filter(required, lambda x: NOT list_contains(have, x))) AS missing FROM h, k),
  d AS (SELECT *, list_filter(dropped, lambda x: x IN ('truncation', 'destination_size')) AS fatal FROM b)
  SELECT patch_id, target, CASE WHEN target = 'PPF4' THEN 'refuse: never from records' WHEN len(fatal) > 0 THEN 'refuse: drops ' || array_to_string(fatal, ',')
   WHEN len(missing) > 0 THEN 'refuse: lacks ' || array_to_string(missing, ',') ELSE 'accept' END AS verdict, array_to_string(dropped, ',') AS dropped FROM d""")
def convert_contracts(spark, sf_dir):
    return convert.test(have(spark, sf_dir), dims.contracts(spark))


@query(f""", {HAVE}, m AS (SELECT * FROM (VALUES {", ".join(f"('{f[0]}', {sql_list(dims.METADATA.get(f[0], []))}::VARCHAR[])" for f in dims.FORMATS)}) v(format, accepts)),
  q AS (SELECT patch_id, format, accepts, list_sort(list_filter(have, lambda x: NOT list_contains(accepts, x))) AS extra FROM h, m)
  SELECT patch_id, format, array_to_string(extra, ',') AS refused, len(extra) = 0 AS ok FROM q""")
def metadata_requests(spark, sf_dir):
    asked = have(spark, sf_dir).withColumnRenamed("have", "asked").crossJoin(F.broadcast(dims.formats(spark).select("format")))
    return convert.metadata(asked, dims.metadata(spark))


def document_pairs(spark, sf_dir):
    """(pair_id, source, target): every document's bytes and those of the one before it, whole."""
    from .operators import images

    return images.neighbours(images.documents(table(spark, sf_dir, "documents")))


PAIRS = """, im AS (SELECT doc_id, text, encode(coalesce(text, '')) AS b, row_number() OVER (ORDER BY doc_id) AS rank FROM documents),
  pr AS (SELECT t.doc_id AS pair_id, s.b AS source, t.b AS target, coalesce(s.text, '') AS source_text, coalesce(t.text, '') AS target_text, octet_length(s.b)::BIGINT AS sn, octet_length(t.b)::BIGINT AS tn FROM im s JOIN im t ON t.rank = s.rank + 1)
"""

#: Whether a format can carry a pair, as the oracle has it. Texts have no zero bytes.
CARRIES = {
    "IPS32": "tn >= sn", "EBP": "tn >= sn", "PPF4": "tn >= sn", "NINJA1": "tn >= sn", "PMSR": "tn >= sn",
    "PPF2": "tn >= sn AND sn >= 38688", "UPS": "tn >= sn",
}


def edited_documents(spark, sf_dir):
    """(pair_id, source, target): every document's bytes, and the same with its vowels in capitals, for formats
    that cannot change an image's size."""
    text = F.coalesce("text", F.lit(""))
    source, target = (F.encode(t, "UTF-8") for t in (text, F.translate(text, "aeiou", "AEIOU")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), source.alias("source"), target.alias("target"))


EDITS = """, pr AS (SELECT doc_id AS pair_id, encode(coalesce(text, '')) AS source, encode(translate(coalesce(text, ''), 'aeiou', 'AEIOU')) AS target FROM documents)
"""
SAME_SIZE = ("PPF1", "PPF3")


def pairs_for(fmt: str):
    return (edited_documents, EDITS, "TRUE") if fmt in SAME_SIZE else (document_pairs, PAIRS, CARRIES.get(fmt, "TRUE"))


def round_trip(fmt: str):
    """Creates a patch for every pair, detects, parses and applies it: what comes out, by its SHA-1."""
    of_pairs, view, ok = pairs_for(fmt)

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .operators import apply, create

        pairs = of_pairs(spark, sf_dir).withColumnRenamed("pair_id", "id")
        made = create.create_patches(pairs, fmt).withColumnRenamed("error", "refused")
        both = made.join(pairs.select("id", F.col("source").alias("image")), "id")
        done = apply.apply_patches(both.filter("patch IS NOT NULL")).select("id", F.sha1("output").alias("sha1"))
        return made.select("id", F.col("refused").isNotNull().alias("refused")).join(done, "id", "left").select(F.col("id").alias("pair_id"), "refused", "sha1")

    name = "round_trip_" + fmt.lower().replace("-", "_")
    QUERIES[name] = f
    SQL[name] = "WITH " + RECORDS + view + f"SELECT pair_id, NOT ({ok}) AS refused, CASE WHEN {ok} THEN sha1(target) END AS sha1 FROM pr"


for _fmt in [x[0] for x in dims.FORMATS]:
    round_trip(_fmt)


def undone(fmt: str):
    """Creates a patch for every pair it can carry, and takes it off the target again."""
    of_pairs, view, ok = pairs_for(fmt)

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .operators import apply, create

        pairs = of_pairs(spark, sf_dir).withColumnRenamed("pair_id", "id")
        made = create.create_patches(pairs, fmt).filter("patch IS NOT NULL").select("id", "format", "patch")
        both = made.join(pairs.select("id", F.col("target").alias("image")), "id")
        return apply.apply_patches(both, backwards=True).select(F.col("id").alias("pair_id"), F.sha1("output").alias("sha1"))

    name = "undo_" + fmt.lower()
    QUERIES[name] = f
    SQL[name] = "WITH " + RECORDS + view + f"SELECT pair_id, sha1(source) AS sha1 FROM pr WHERE {ok}"


for _fmt in ("UPS", "PPF3", "NINJA2"):
    undone(_fmt)


def chunks(spark, sf_dir, size=4096):
    from .operators import diff

    pairs = document_pairs(spark, sf_dir)
    return diff.chunked(pairs, "pair_id", "source", size), diff.chunked(pairs, "pair_id", "target", size), pairs


BYTES = PAIRS + """, cs AS (SELECT pair_id, sn, tn, [CAST('0x' || x AS INTEGER) FOR x IN regexp_extract_all(hex(source), '..')] AS s, [CAST('0x' || x AS INTEGER) FOR x IN regexp_extract_all(hex(target), '..')] AS t FROM pr),
  bt AS (SELECT pair_id, unnest(t) AS b, unnest(s || list_resize([]::INTEGER[], greatest(0, tn - sn)::BIGINT)) AS a, unnest(generate_series(0, greatest(sn, tn) - 1)) AS pos, tn FROM cs),
  df AS (SELECT pair_id, pos, pos - lag(pos) OVER (PARTITION BY pair_id ORDER BY pos) AS step FROM bt WHERE pos < tn AND a IS DISTINCT FROM b)
"""


def islands_sql(gap: int) -> str:
    return f""", il AS (SELECT pair_id, pos, sum(CASE WHEN step > {gap + 1} THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY pos) AS island FROM df),
  hk AS (SELECT pair_id, min(pos)::BIGINT AS start, max(pos)::BIGINT + 1 AS "end" FROM il GROUP BY pair_id, island)
"""


@query(BYTES + islands_sql(5) + 'SELECT pair_id, start, "end" FROM hk')
def diff_hunks(spark, sf_dir):
    from .operators import diff

    source, target, _ = chunks(spark, sf_dir)
    return diff.hunks(source, target, 5, chunk=4096)


@query(BYTES + islands_sql(5) + """, tl AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY pair_id ORDER BY start), 0) AS before FROM hk), la AS (SELECT pair_id, max("end") AS start FROM hk GROUP BY pair_id)
  SELECT pair_id, start, "end", 'data' AS op FROM hk UNION ALL SELECT pair_id, before, start, 'copy' FROM tl WHERE start > before
  UNION ALL SELECT pr.pair_id, coalesce(la.start, 0), tn, 'copy' FROM pr LEFT JOIN la USING (pair_id) WHERE tn > coalesce(la.start, 0)""")
def copy_data_tiles(spark, sf_dir):
    from .operators import diff

    source, target, pairs = chunks(spark, sf_dir)
    sizes = pairs.select("pair_id", F.octet_length("target").cast("long").alias("target_size"))
    return diff.tiles(diff.hunks(source, target, 5, chunk=4096), sizes)


@query(BYTES + """, df2 AS (SELECT pair_id, pos, pos - lag(pos) OVER (PARTITION BY pair_id ORDER BY pos) AS step FROM bt WHERE coalesce(a, 0) <> coalesce(b, 0)),
  il AS (SELECT pair_id, pos, sum(CASE WHEN step > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY pos) AS island FROM df2),
  hk AS (SELECT pair_id, min(pos)::BIGINT AS start, max(pos)::BIGINT + 1 AS "end" FROM il GROUP BY pair_id, island)
  SELECT pair_id, start, "end", start - coalesce(lag("end") OVER (PARTITION BY pair_id ORDER BY start) + 1, 0) AS skip FROM hk""")
def xor_blocks(spark, sf_dir):
    from .operators import diff

    source, target, _ = chunks(spark, sf_dir)
    return diff.xor_blocks(source, target, chunk=4096)


@query(BYTES + "SELECT DISTINCT pair_id, pos // 4096 AS chunk_no FROM bt WHERE coalesce(a, 0) <> coalesce(b, 0)")
def changed_blocks(spark, sf_dir):
    from .operators import diff

    source, target, _ = chunks(spark, sf_dir)
    return diff.changed_blocks(source, target)


@query(""", cs AS (SELECT doc_id AS image_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS xs FROM documents),
  bt AS (SELECT image_id, unnest(xs) AS x, unnest(generate_series(0, len(xs) - 1)) AS pos FROM cs WHERE len(xs) > 0),
  st AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY image_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM bt),
  il AS (SELECT *, sum(fresh) OVER (PARTITION BY image_id ORDER BY pos) AS run FROM st)
  SELECT image_id, min(pos)::BIGINT AS start, max(pos)::BIGINT + 1 AS "end", CAST('0x' || any_value(x) AS INTEGER) AS value FROM il GROUP BY image_id, run HAVING count(*) >= 4""")
def byte_runs(spark, sf_dir):
    from .operators import diff, images

    return diff.byte_runs(images.documents(table(spark, sf_dir, "documents")))


@query(""", im AS (SELECT doc_id AS image_id, encode(coalesce(text, '')) AS b FROM documents)
  SELECT image_id, octet_length(b)::BIGINT AS size, md5(b) AS md5, sha1(b) AS sha1 FROM im""")
def image_digests(spark, sf_dir):
    from .functions import checksums
    from .operators import images

    return images.documents(table(spark, sf_dir, "documents")).select("image_id", *[c for k, c in enumerate(checksums.digests(F.col("bytes"))) if k != 1])


@query(""", im AS (SELECT doc_id AS image_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
  SELECT image_id, sha1(CASE WHEN length(h) // 2 > 1024 THEN left(h, 1024) || right(h, 512) || '.' || (length(h) // 2)::VARCHAR ELSE h END) AS sample FROM im""")
def hash_samples(spark, sf_dir):
    """The sample of large images, at a small scale; hex, as the oracle compares texts."""
    from .functions import checksums
    from .operators import images

    rows = images.documents(table(spark, sf_dir, "documents"))
    size = F.octet_length("bytes")
    sample = checksums.hash_sample(F.col("bytes"), 1024, 512, 256)
    large = F.concat(F.hex(sample.substr(F.lit(1), F.lit(768))), F.lit("."), size.cast("string"))
    return rows.select("image_id", F.sha1(F.when(size > 1024, large).otherwise(F.hex("bytes"))).alias("sample"))


@query(""", im AS (SELECT doc_id AS image_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
  SELECT image_id, CASE WHEN length(h) > 128 THEN left(h, 128) || '...' ELSE h END AS dump, length(h) >= 8 AND h = repeat(left(h, 2), length(h) // 2) AS one_byte FROM im""")
def hex_dumps(spark, sf_dir):
    from .functions import display
    from .operators import images

    return images.documents(table(spark, sf_dir, "documents")).select("image_id", display.hex_dump(F.col("bytes")).alias("dump"), records.runs_of_one_byte(F.col("bytes")).alias("one_byte"))


def reassembled(chunked: DataFrame, key: str) -> DataFrame:
    """Whole images of their chunks, in order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "bytes"))), lambda c: F.hex(c["bytes"]))
    return chunked.groupBy(key).agg(F.unhex(F.array_join(parts, "")).alias("bytes"))


def cut_hunks(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(image_id, off, ordinal, old, new) of hunks and the pairs they are of. An image meets its hunks as one row and
    is cut there: joined hunk by hunk, it would be sorted and buffered as often as it has hunks."""
    hunks = found.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hunks"))

    def cut(h):
        at, size = (h["start"] + 1).cast("int"), (h["end"] - h["start"]).cast("int")
        return F.struct(h["start"].alias("off"), F.col("source").substr(at, size).alias("old"), F.col("target").substr(at, size).alias("new"))

    each = pairs.join(hunks, "pair_id").select(F.col("pair_id").alias("image_id"), F.posexplode(F.transform("hunks", cut)).alias("at", "h"))
    return each.select("image_id", "h.off", (F.col("at") + 1).alias("ordinal"), "h.old", "h.new")


def overlaid(how: str):
    """Hunks of edited documents, put on the chunks of the originals."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .operators import apply, diff

        pairs = edited_documents(spark, sf_dir)
        source, target = (diff.chunked(pairs, "pair_id", c, 4096) for c in ("source", "target"))
        found = staged(diff.hunks(source, target, 5, chunk=4096), "hunks")
        base = cut_hunks(found, pairs)
        images = source.withColumnRenamed("pair_id", "image_id")
        if how == "overlay":
            # what is written twice ends as what is written last
            wrong = base.select("image_id", "off", F.lit(-1).alias("ordinal"), F.col("old").alias("payload"))
            done = apply.overlay_chunks(images, base.select("image_id", "off", "ordinal", F.col("new").alias("payload")).unionByName(wrong), 4096)
        else:
            masks = base.select("image_id", "off", "ordinal", mask(F.col("old"), F.col("new")).alias("payload"))
            masks = staged(masks, "masks")
            dropped(found)
            done = staged(apply.xor_chunks(images, masks, 4096), "patched")
            dropped(masks)
        return reassembled(done, "image_id").select(F.col("image_id").alias("pair_id"), F.sha1("bytes").alias("sha1"))

    QUERIES[f"{how}_chunks"] = f
    SQL[f"{how}_chunks"] = "WITH " + RECORDS + EDITS + "SELECT pair_id, sha1(target) AS sha1 FROM pr"


def mask(a, b):
    """The exclusive or of two byte columns."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("binary")
    def f(x, y):
        # all rows at once; a shorter first column counts as zeros beyond its end
        one = b"".join([p[: len(q)].ljust(len(q), b"\0") for p, q in zip(x, y)])
        both = (np.frombuffer(one, np.uint8) ^ np.frombuffer(b"".join(y), np.uint8)).tobytes()
        ends = np.cumsum([0, *map(len, y)]).tolist()
        return pd.Series([both[i:j] for i, j in zip(ends, ends[1:])], dtype=object)

    return f(a, b)


for _how in ("overlay", "xor"):
    overlaid(_how)


@query(BYTES + islands_sql(5) + """SELECT pair_id AS patch_id, count(*) AS n_hunks, sum("end" - start)::BIGINT AS n_bytes, min(start) AS first, max("end") AS last FROM hk JOIN pr USING (pair_id) WHERE tn >= sn GROUP BY pair_id""")
def parsed_regions(spark, sf_dir):
    """Patches made of document pairs, read back as records and summed up as regions."""
    from .operators import create
    from .sources import containers

    pairs = document_pairs(spark, sf_dir).withColumnRenamed("pair_id", "id")
    made = create.create_patches(pairs, "IPS32").filter("patch IS NOT NULL").select(F.col("id").alias("patch_id"), F.col("patch").alias("content"))
    rows = containers.regions(containers.records(made))
    # records of one hunk follow each other without a gap of more than the format closes
    w = Window.partitionBy("patch_id").orderBy("ordinal")
    fresh = F.coalesce((F.col("off") - F.lag(F.col("off") + F.col("len")).over(w) > 5).cast("int"), F.lit(1))
    return rows.withColumn("fresh", fresh).groupBy("patch_id").agg(
        F.sum("fresh").alias("n_hunks"), F.sum("len").alias("n_bytes"), F.min("off").alias("first"), F.max(F.col("off") + F.col("len")).alias("last")
    )


DETECTED = [f[0] for f in dims.FORMATS]


@query(PAIRS + "SELECT made, made AS detected, sum(ok)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS made, count(*) FILTER ({CARRIES.get(f, 'sn = tn' if f in SAME_SIZE else 'TRUE')}) AS ok FROM pr" for f in DETECTED) + ") GROUP BY made HAVING sum(ok) > 0")
def detected_formats(spark, sf_dir):
    """A patch of every format for every pair, and what it is taken for."""
    from functools import reduce

    from .operators import create, images
    from .sources import containers

    pairs = document_pairs(spark, sf_dir).withColumnRenamed("pair_id", "id")
    made = reduce(DataFrame.unionByName, [create.create_patches(pairs, f) for f in DETECTED]).filter("patch IS NOT NULL")
    numbered = made.select((F.col("id") * 100 + F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(DETECTED) for x in (f, k)]), F.col("format"))).alias("patch_id"), F.col("patch").alias("content"))
    found = containers.headers(numbered).select((F.col("patch_id") % 100).cast("int").alias("k"), F.col("format").alias("detected"))
    names = F.array(*map(F.lit, DETECTED))
    return found.select(F.element_at(names, F.col("k") + 1).alias("made"), "detected").groupBy("made", "detected").agg(F.count(F.lit(1)).alias("n"))


@query(PAIRS + "SELECT pair_id AS patch_id, 2 AS n_checks, 0 AS n_wrong, 'matches' AS verdict FROM pr")
def verified_patches(spark, sf_dir):
    """Patches with checksums, weighed against their sources."""
    from .operators import create
    from .plans import explain

    pairs = document_pairs(spark, sf_dir).withColumnRenamed("pair_id", "id")
    made = create.create_patches(pairs, "BPS").select(F.col("id").alias("patch_id"), F.col("patch").alias("content"))
    sources = pairs.select(F.col("id").alias("patch_id"), F.col("source").alias("bytes"))
    return explain.verified(made, sources).select("patch_id", "n_checks", "n_wrong", "verdict").withColumns({c: F.col(c).cast("int") for c in ("n_checks", "n_wrong")})


@query(PAIRS + "SELECT pair_id, sha1(target) AS sha1 FROM pr WHERE tn >= sn")
def converted_patches(spark, sf_dir):
    """Patches converted from one format to another by way of their output, and applied in the new one."""
    from .operators import apply, create
    from .plans import explain

    pairs = document_pairs(spark, sf_dir).withColumnRenamed("pair_id", "id")
    made = create.create_patches(pairs, "BPS").select(F.col("id").alias("patch_id"), F.col("patch").alias("content"))
    sources = pairs.select(F.col("id").alias("patch_id"), F.col("source").alias("bytes"))
    new = explain.converted(made, sources, "UPS").filter("patch IS NOT NULL").select("id", "format", "patch")
    done = apply.apply_patches(new.join(pairs.select("id", F.col("source").alias("image")), "id"))
    return done.select(F.col("id").alias("pair_id"), F.sha1("output").alias("sha1"))
