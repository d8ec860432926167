"""The operators' queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus.llm import bpe, decontaminate, licenses, planes, quality, secrets, simhash, transport, urls, warc
from quercus.llm.common import read, written


#: Fixed values of the query's contract.
URL_RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]


def op1_url_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op2_warc_seekable_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(read(spark, sf_dir, "pages"))
    return found.select(warc.id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.id_of("refers_to_id").alias("refers_to"))


def op3_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = planes.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return found.withColumnRenamed("id", "doc_id")


def op4_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), k=3, max_bits=2)
    return found.select(found.id.alias("doc_id"), "fingerprint", "component_id")


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), drop_columns=True)


def op6_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    of_kind = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *(F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(of_kind("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op7_license_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt")))
    return licenses.inherited(licenses.scan(read(spark, sf_dir, "documents"), "doc_id", "text", path)).withColumnRenamed("id", "doc_id")


def op8_prefix_filter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = written(transport.stored(read(spark, sf_dir, "documents").select("doc_id", "text")), "media", compression="zstd")
    return transport.indexed(media).drop("units")


def op10_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_url_markov_ratio": op1_url_markov_ratio,
    "op2_warc_seekable_zstd": op2_warc_seekable_zstd,
    "op3_bit_planes": op3_bit_planes,
    "op4_simhash_index": op4_simhash_index,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_secret_battery": op6_secret_battery,
    "op7_license_cosine": op7_license_cosine,
    "op8_prefix_filter_join": op8_prefix_filter_join,
    "op9_transport_stream": op9_transport_stream,
    "op10_bpe_prefix_dp": op10_bpe_prefix_dp,
}
#: SHA-1 as base32: eight times five hex digits, each as four signs.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {shift}) & 31)::BIGINT, 1)" for g in range(8) for shift in (15, 10, 5, 0))
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The other queries need models, hashes or encoders that SQL lacks; tests hold them against plain versions.
ORACLE_SQL = {
    "op2_warc_seekable_zstd": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT payload, max(page_id) AS kept FROM p GROUP BY payload)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to FROM p JOIN k USING (payload)""",
    "op8_prefix_filter_join": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS k FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, unnest(list_transform(range(0, len(w) - n + 1), lambda i: {{'i': i, 'k': array_to_string(w[i + 1:i + n], ' ')}})) AS p FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, p.i AS i, pos.n, item_id FROM pos JOIN win ON win.n = pos.n AND win.k = p.k),
cov AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ids USING (doc_id)""",
}
