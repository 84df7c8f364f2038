"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, exact_dedup, quality, secrets, simhash, substring, token_files, warc
from ._io import new_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    back = chat_format.read_back(chat_format.examples(rows.unionByName(extra)))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


SQL["op4_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(14 - 1 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g'))
                + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g'))) OVER w AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "digest_index")
    index = exact_dedup.DigestIndex(spark, path.rpartition("/")[2].replace("-", "_"), path)
    found = exact_dedup.groups(table(spark, sf_dir, "documents"), index)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL["op6_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.covered(F.col("spans"))
    return found.select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


SQL["op8_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), b1 AS (
  SELECT item_id, ws, least(10, len(ws)) AS m FROM b WHERE len(ws) > 0
), w AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i : i + m - 1], ' ') AS g
  FROM (SELECT item_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM b1)
), hits AS (
  SELECT DISTINCT doc_id, i, m, item_id
  FROM (SELECT doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') AS g
        FROM (SELECT doc_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM w) WHERE len(ws) >= m))
  JOIN w USING (m, g)
), pos AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(generate_series(0, m - 1)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id
), own AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(ws) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN own USING (doc_id)
"""


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(enc: bpe.Encoder, text: str | None):
        ids = enc.encode(text)
        written = ",".join(map(enc.strings.__getitem__, ids))
        back = enc.decode(ids).encode()
        return len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(back).hexdigest()

    return bpe.map_texts(
        table(spark, sf_dir, "documents"), "n_tokens long, ids_sha256 string, decoded_sha256 string", digest
    )


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("doc.doc_id").alias("doc_id"), "p_text", "p_page", "score", "keep")


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    sure = F.filter("spans", lambda x: x["kind"] != "model")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    return found.select(
        "doc_id", *map(count, ("assign", "access", "hex")), F.sha2(said(sure), 256).alias("base_sha256"), said(F.col("spans")).alias("spans")
    )


@query
def op1_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' archive against a replica in which every 97th page id has a damaged last byte and every
    211th is lost."""
    whole = warc.archive(table(spark, sf_dir, "pages"))
    hurt = F.col("page_id") % 97 == 13
    bad = F.concat(F.expr("substring(record, 1, length(record) - 1)"), F.encode(F.lit("X"), "UTF-8"))
    replica = whole.filter("page_id IS NULL OR page_id % 211 <> 5").select("offset", F.when(hurt, bad).otherwise(F.col("record")).alias("record"))
    found = warc.audit(whole.select("offset", "record"), replica)
    return found.join(whole.select("offset", "page_id", "length"), "offset").select(
        "page_id", "offset", "length", "kind", "expected", "found"
    )


SQL["op1_warc_audit"] = r"""
WITH r AS (
  SELECT DISTINCT page_id, 'WARC/1.0' || n || 'WARC-Type: response' || n || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || n
    || 'WARC-Target-URI: ' || coalesce(url, '') || n || 'Content-Type: text/html' || n || 'Content-Length: '
    || octet_length(encode(coalesce(html, '')))::VARCHAR || n || n || coalesce(html, '') || n || n AS record
  FROM pages, (SELECT chr(13) || chr(10) AS n)
), o AS (
  SELECT page_id, record, octet_length(encode(record))::BIGINT AS length, sha256(record) AS expected FROM r
), p AS (
  SELECT *, (sum(length) OVER (ORDER BY page_id NULLS FIRST, expected ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS "offset" FROM o
)
SELECT page_id, "offset", length, CASE WHEN page_id % 211 = 5 THEN 'missing' ELSE 'corrupt' END AS kind, expected,
       CASE WHEN page_id % 211 = 5 THEN NULL ELSE sha256(left(record, length(record) - 1) || 'X') END AS found
FROM p WHERE page_id % 97 = 13 OR page_id % 211 = 5
"""


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op5_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM d WHERE len(ws) >= 50)
), f AS (
  SELECT h, min(doc_id) AS least FROM g GROUP BY h
), lost AS (
  SELECT DISTINCT doc_id, i + k AS p FROM (SELECT g.doc_id, g.i FROM g JOIN f USING (h) WHERE least < g.doc_id), (SELECT unnest(generate_series(0, 49)) AS k)
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM d) w ANTI JOIN lost ON lost.doc_id = w.doc_id AND lost.p = w.p
  GROUP BY w.doc_id
)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_files.write(table(spark, sf_dir, "documents"))
    return token_files.each_document(shards, "ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()))
