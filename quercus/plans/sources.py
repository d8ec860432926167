"""Queries through readers and sinks: tables are written in a format, read back by its reader, and must be what they were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quercus.functions import hashing
from quercus.functions import text as T
from quercus.functions.tables import read, scratch
from quercus.operators import catalog
from quercus.plans.registry import query
from quercus.sources import readers, sinks


def _text(lines: DataFrame, path: str, sep: str = "\n") -> str:
    """One file of lines (value), in order of n."""
    lines.orderBy("n").select("value").coalesce(1).write.option("lineSep", sep).text(path)
    return path


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


_NOTE = "CASE WHEN p_partkey % 4 = 0 THEN p_name || ' \"x\",' || chr(10) || p_type ELSE '' END"


@query(
    f"""WITH c AS (SELECT p_partkey AS k, p_name AS name, p_type AS category, p_brand AS winery, replace(p_name, ' ', '-') || '-' || (p_partkey // 2) AS slug, {_NOTE} AS note FROM part)
SELECT slug, count(*) AS n_rows, any_value(name) AS name, any_value(note) AS description FROM c GROUP BY slug, name, category, winery, note"""
)
def csv_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue file with quotes and line ends inside fields, read by row numbers and deduplicated over its nine columns."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    note = F.when(k % 4 == 0, F.concat("p_name", F.lit(' "x",\n'), "p_type")).otherwise("")
    slug = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.floor(k / 2).cast("string"))
    columns = [F.col("p_name"), F.col("p_type"), F.lit(""), F.lit(""), F.lit(""), note, F.col("p_brand"), slug, F.lit("")]
    body = p.select((k + 1).alias("n"), F.concat_ws(",", *map(_quoted, columns)).alias("value"))
    header = spark.createDataFrame([(0, "﻿" + ",".join(readers.CSV_FIELDS))], "n bigint, value string")
    rows = readers.catalogue_csv(spark, _text(header.unionByName(body), scratch(spark, "csv")))
    records, _ = catalog.cleaned(rows.withColumnRenamed("source_row", "pos"), catalog.FIELDS, "pos")
    raw = F.coalesce(F.try_element_at("raw_overrides", F.lit("description")), F.col("description"))
    return records.select("slug", "n_rows", "name", raw.alias("description"))


@query("SELECT 'r' || (event_id % 50) AS slug, max(CASE WHEN event_id < 50 THEN event_type END) AS name, (event_id % 50)::BIGINT AS k FROM events GROUP BY event_id % 50")
def catalogue_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object with a list of items: title stands in for name, strings are trimmed, rows without a name go, the first of a slug stays."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    item = F.to_json(F.struct(F.concat(F.lit(" r"), (k % 50).cast("string"), F.lit(" ")).alias("slug"), F.when(k % 2 == 0, F.col("event_type")).alias("name"), F.when(k % 2 == 1, F.concat("event_type", F.lit(" "))).alias("title"), k.alias("pos")))
    empty = F.when(k % 10 == 3, F.to_json(F.struct(F.lit("none").alias("slug"), F.lit(" ").alias("name"), k.alias("pos"))))
    lines = e.select(k.alias("n"), F.concat_ws(", ", F.when(k > 0, F.lit("")), item, empty).alias("value")).unionByName(spark.createDataFrame([(-1, '{"other": 1, "items": ['), (1 << 60, "]}")], "n bigint, value string"))
    path = scratch(spark, "json") + ".json"
    found = readers.catalogue(readers.records(spark, _text(lines, path, " ")), "pos")
    return found.select("slug", "name", F.regexp_extract("slug", "r([0-9]+)", 1).cast("bigint").alias("k"))


@query("SELECT format, o_orderkey::VARCHAR AS id, o_orderpriority AS priority FROM orders, (SELECT unnest(['csv', 'jsonl', 'ndjson', 'txt', 'tsv']) AS format)")
def record_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the file's name, and by the delimiter found where the name says nothing."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("priority"))
    out = None
    for kind, sep in (("csv", ","), ("tsv", "\t"), ("txt", ";"), ("jsonl", None), ("ndjson", None)):
        value = F.to_json(F.struct("id", "priority")) if sep is None else F.concat_ws(sep, "id", "priority")
        lines = o.select("n", value.alias("value"))
        if sep:
            lines = lines.unionByName(spark.createDataFrame([(-1, f"id{sep}priority")], "n bigint, value string"))
        found = readers.records(spark, _text(lines, f"{scratch(spark, 'records')}.{kind}")).select(F.lit(kind).alias("format"), F.col("id").cast("string").alias("id"), "priority")
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT 'strict' AS reader, event_id, event_type, value FROM events UNION ALL SELECT 'lenient', event_id, event_type, value FROM events")
def jsonl_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    lines = e.select(F.col("event_id").alias("n"), F.concat(F.to_json(F.struct(*e.columns)), F.when(F.col("event_id") % 3 == 0, "\n  ").otherwise("")).alias("value"))
    path = _text(lines, scratch(spark, "lines"))
    schema = S.StructType([S.StructField("event_id", S.LongType()), S.StructField("event_type", S.StringType()), S.StructField("value", S.DoubleType())])
    tagged = lambda df, name: df.select(F.lit(name).alias("reader"), *e.columns)
    return tagged(readers.strict_jsonl(spark, path, schema), "strict").unionByName(tagged(readers.lenient_jsonl(spark, path, schema).where("event_id is not null"), "lenient"))


@query(
    """WITH f AS (SELECT doc_id, source || '/d' || (doc_id % 700) || '.txt' AS path, sha256('t' || doc_id) AS h FROM documents), g AS (SELECT path, h FROM f),
s AS (SELECT 'd' || k || '.txt' AS asked FROM (SELECT unnest(range(0, 700)) AS k) WHERE k < (SELECT count(*) FROM documents))
SELECT asked AS image_path, CASE WHEN count(DISTINCT h) = 1 THEN min(h) END AS sha256 FROM s JOIN g ON ends_with(path, '/' || asked) GROUP BY asked"""
)
def checksum_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GNU checksum list, and the checksums of files that it names by longer paths; null where several of them differ."""
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("d"), (F.col("doc_id") % 700).cast("string"), F.lit(".txt"))
    line = F.concat(F.upper(F.sha2(F.concat(F.lit("t"), F.col("doc_id").cast("string")), 256)), F.when(F.col("doc_id") % 2 == 0, "  ./").otherwise(" *"), F.replace("source", F.lit("/"), F.lit("\\")), F.lit("/"), name)
    known = readers.checksums(spark, _text(d.select(F.col("doc_id").alias("n"), line.alias("value")), scratch(spark, "checksums")))
    return readers.checksum_for(d.select(name.alias("image_path")).distinct(), known)


@query("SELECT 'c' || c_custkey AS slug, unnest([c_name, c_mktsegment]) AS alias FROM customer")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    entry = F.concat(F.lit('"c'), F.col("c_custkey").cast("string"), F.lit('": '), F.to_json(F.array("c_name", "c_mktsegment")))
    lines = c.select(F.col("c_custkey").alias("n"), F.concat(F.when(F.col("c_custkey") > 0, ", ").otherwise(""), entry).alias("value")).unionByName(spark.createDataFrame([(-1, "{"), (1 << 60, "}")], "n bigint, value string"))
    return readers.name_lists(spark, _text(lines, scratch(spark, "aliases")))


@query("SELECT 'c' || c_custkey AS photo_name, c_name || '/' || c_mktsegment AS path FROM customer")
def override_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    entry = F.concat(F.lit('"c'), F.col("c_custkey").cast("string"), F.lit('": "'), F.concat_ws("/", "c_name", "c_mktsegment"), F.lit('"'))
    lines = c.select(F.col("c_custkey").alias("n"), F.concat(F.when(F.col("c_custkey") > 0, ", ").otherwise(""), entry).alias("value")).unionByName(spark.createDataFrame([(-1, "{"), (1 << 60, "}")], "n bigint, value string"))
    return readers.overrides(spark, _text(lines, scratch(spark, "overrides")))


@query(
    """SELECT 'm/uploads/' || p_brand || '/' || p_name || '.png' AS path, (p_partkey * 7)::BIGINT AS size, upper(left(sha256('c' || p_partkey), 8)) AS crc, p_partkey % 5 = 0 AS repeated
FROM part WHERE p_partkey % 4 <> 1 AND p_partkey % 9 <> 2"""
)
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archiver's listing: blocks of Key = value lines; folders and other places are left out, of repeated keys the last counts."""
    k = F.col("p_partkey")
    folder = F.when(k % 4 == 1, "other").otherwise("uploads")
    size = F.concat(F.lit("Size = "), (k * 7).cast("string"))
    block = F.concat_ws(
        "\n", F.concat(F.lit("Path = m\\"), folder, F.lit("\\"), F.concat_ws("/", "p_brand", "p_name"), F.lit(".png")), F.when(k % 5 == 0, "Size = 1"), size, F.lit("Packed Size = "), F.lit("Method = a = b"),
        F.concat(F.lit("CRC = "), F.substring(F.sha2(F.concat(F.lit("c"), k.cast("string")), 256), 1, 8)), F.when(k % 9 == 2, "Folder = +"),
    )
    path = _text(read(spark, sf_dir, "part").select(k.alias("n"), block.alias("value")), scratch(spark, "listing"), "\n\n")
    found = readers.archive_listing(spark.read.option("lineSep", "\n\n").text(path))
    return found.select("path", "size", "crc", (F.col("size") % 35 == 0).alias("repeated"))


@query(
    """SELECT page_id AS source_page, 's' || page_id || '-' || i AS slug, 'T' || i AS name, CASE WHEN i = 1 THEN 'img/uploads/' || page_id || '.png' END AS image_url, CASE WHEN i = 1 THEN page_id || '.png' ELSE '' END AS photo_name,
  'site/wines/s' || page_id || '-' || i AS source_url, 'now' AS observed_at, false AS index_ready, 'pending' AS media_status FROM pages, (SELECT unnest([0, 1, 2]) AS i)"""
)
def listing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings embedded in captured pages as flat lists of pointers, resolved and made rows."""
    page = F.col("page_id").cast("string")
    item = lambda i: F.concat(F.lit('{"slug": '), F.lit(str(10 + 3 * i)), F.lit(', "title": '), F.lit(str(11 + 3 * i)), F.lit(', "image": '), F.lit(str(12 + 3 * i)), F.lit("}"))
    image = lambda i: F.lit('{"url": 19}') if i == 1 else F.lit("null")
    flat = [F.lit('["Reactive", 1]'), F.lit('{"currentPage": 2, "totalItems": 3, "totalPages": 2, "items": 4, "more": -5}'), page, F.lit("3"), F.lit('["ShallowRef", 5]'), F.lit("[6, 7, 8]"), item(0), item(1), item(2), F.lit("[]")]
    for i in range(3):
        flat += [F.concat(F.lit('"s'), page, F.lit(f'-{i}"')), F.lit(f'"T{i}"'), image(i)]
    flat.append(F.concat(F.lit('"/uploads/'), page, F.lit('.png"')))
    payload = F.concat(F.lit("["), F.concat_ws(", ", *flat), F.lit("]"))
    html = F.concat(F.substring_index("html", "</body>", 1), F.lit('<script type="application/json" id="__NUXT_DATA__">'), payload, F.lit("</script></body>"))
    listed = readers.listings(read(spark, sf_dir, "pages").select("page_id", html.alias("html")))
    rows = readers.snapshot_rows(listed, "page_id", "site", "img", {"observed_at": "now"})
    return rows.select("source_page", "slug", "name", "image_url", "photo_name", "source_url", "observed_at", "index_ready", "media_status")


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'webp' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' END AS kind, CASE WHEN doc_id % 5 = 0 THEN 'ok' WHEN doc_id % 7 = 0 THEN 'bad' ELSE 'ok' END AS verified FROM documents"""
)
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by the first bytes; sizes and CRC-32 against what an archive declares."""
    heads = [F.concat(F.unhex(F.lit("524946460000000057454250"))), F.unhex(F.lit("FFD8AA")), F.unhex(F.lit("89504E470D0A1A0A")), F.unhex(F.lit("89504E47")), F.unhex(F.lit(""))]
    k = F.col("doc_id")
    content = F.concat(F.element_at(F.array(*heads), (k % 5 + 1).cast("int")), F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    d = read(spark, sf_dir, "documents").select("doc_id", content.alias("c"))
    declared = F.when((k % 7 == 0) & (k % 5 != 0), F.lit("00000000")).otherwise(F.lower(hashing.crc32_hex(F.col("c"))))
    return d.select("doc_id", hashing.image_kind(F.col("c")).alias("kind"), F.when(hashing.verified(F.octet_length("c"), declared, F.col("c")), "ok").otherwise("bad").alias("verified"))


_LINE = """'{"n":' || coalesce(n::VARCHAR, 'null') || ',"name":' || CASE WHEN p_size % 3 = 0 THEN 'null' ELSE '"' || p_name || ' é"' END || ',"p_partkey":' || p_partkey || '}'"""


@query(f"SELECT p_partkey, {_LINE} AS value, row_number() OVER (ORDER BY p_brand, p_partkey) AS place FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_size END AS n FROM part)")
def jsonl_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with nulls, columns by name and rows in order, put in the place of an older file."""
    from quercus.operators import evaluate

    p = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.concat("p_name", F.lit(" é"))).alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("n"), "p_brand")
    path = scratch(spark, "sink")
    keyed = p.select("p_partkey", "name", "n")
    sinks.write_jsonl(keyed.limit(1), path, ["p_partkey"])
    sinks.replace_jsonl(keyed, path, ["p_partkey"])
    lines = spark.read.text(path).select(F.get_json_object("value", "$.p_partkey").cast("bigint").alias("p_partkey"), "value")
    placed = evaluate.places(p.withColumn("o", F.struct("p_brand", "p_partkey")), "o").select("p_partkey", "place")
    return lines.join(placed, "p_partkey")


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, len(embedding)::BIGINT AS size FROM embeddings")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index with its manifest, written, checked against the catalogue, and loaded."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path, size = scratch(spark, "index"), len(e.first()["embedding"])
    sinks.write_index(e, e, path, "vec_id", 3, '{"view": "full"}')
    found = sinks.load_index(spark, path, e, "vec_id", "embedding", size, 3, '{"view": "full"}')
    return found.select("vec_id", F.round(F.get("embedding", 0).cast("double"), 6).alias("first"), F.size("embedding").cast("bigint").alias("size"))


@query("WITH l AS (SELECT user_id, max(event_id) AS seen FROM events GROUP BY user_id) SELECT user_id, seen FROM l ORDER BY seen DESC, user_id LIMIT 5")
def history_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five that were seen last, each once."""
    return sinks.history(read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seen")), "user_id", "seen")


@query("SELECT (SELECT sha256('[' || string_agg('\"' || v || '\"', ',' ORDER BY v) || ']') FROM (SELECT DISTINCT p_name || ' é' AS v FROM part)) AS names")
def key_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" é")).alias("v"))
    return spark.createDataFrame([(hashing.set_fingerprint(names, "v"),)], "names string")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN nullif(c_name, '') WHEN c_custkey % 4 = 1 THEN c_mktsegment END AS label, c_custkey % 3 = 0 AS flag FROM customer"""
)
def named_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first filled column of several names in any case; lenient flags."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    rows = c.select("c_custkey", F.when(k % 4 == 0, F.col("c_name")).otherwise("").alias("TRUE_slug "), F.when(k % 4 == 1, F.col("c_mktsegment")).alias("Label"), F.element_at(F.array(F.lit(" Yes"), F.lit("no"), F.lit("2")), (k % 3 + 1).cast("int")).alias("hard"))
    return rows.select("c_custkey", T.named(rows, ["expected_slug", "true_slug", "label"]).alias("label"), T.lenient_boolean(F.col("hard")).alias("flag"))
