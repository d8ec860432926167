"""Catalogue, audit, evaluation and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quercus.functions import hashing
from quercus.functions import text as T
from quercus.functions.tables import read, written
from quercus.operators import catalog, evaluate, graph, recommend, validate
from quercus.plans.registry import query
from quercus.sources import sinks


def _table(name: str):
    return lambda spark, sf_dir: read(spark, sf_dir, name)


documents, labels, part, lineitem, orders, events, pages = map(_table, ("documents", "labels", "part", "lineitem", "orders", "events", "pages"))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", hashing.sha256(F.coalesce("text", F.lit(""))).alias("text_sha256"))


@query("SELECT min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS source_row, doc_id AS position FROM documents")
def exact_dedup_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _hashed(spark, sf_dir)
    records = written(catalog.deduplicated(d, ["text_sha256"], "doc_id"), "records")
    return catalog.provenance(d, records, ["text_sha256"], "doc_id")


@query("SELECT sha256(coalesce(text, '')) AS text_sha256, min(doc_id) AS source_row, count(*) AS n_rows FROM documents GROUP BY coalesce(text, '')")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.deduplicated(_hashed(spark, sf_dir), ["text_sha256"], "doc_id")


@query("WITH g AS (SELECT count(*) AS n FROM documents GROUP BY coalesce(text, '')) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_unique, (sum(n) - count(*))::BIGINT AS n_removed, count(*) FILTER (n > 1) AS n_groups FROM g")
def duplicate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicate_statistics(exact_dedup(spark, sf_dir))


@query("SELECT DISTINCT p_name AS key, p_brand AS member FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_name <> '' GROUP BY p_name HAVING count(DISTINCT p_brand) > 1)")
def conflict_one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.one_to_many(part(spark, sf_dir), F.col("p_name"), F.col("p_brand"))


_MISSING = """j AS (SELECT doc_id, text, lang, source, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM documents LEFT JOIN labels USING (doc_id)),
u AS (SELECT unnest(['text', 'lang', 'source', 'quality', 'toxic']) AS field, unnest([text, lang, source, quality, toxic]) AS v, doc_id FROM j)"""
_FIELDS = ["text", "lang", "source", "quality", "toxic"]


@query(f"WITH {_MISSING} SELECT field, count(*) AS n_missing, count(*)::BIGINT AS n_source_rows FROM u WHERE coalesce(v, '') = '' GROUP BY field")
def missing_field_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = documents(spark, sf_dir).join(labels(spark, sf_dir), "doc_id", "left")
    return catalog.missing_fields(j, _FIELDS, "doc_id", F.lit(1))


@query(f"WITH {_MISSING} SELECT field, doc_id AS key FROM u WHERE coalesce(v, '') = ''")
def missing_field_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = documents(spark, sf_dir).join(labels(spark, sf_dir), "doc_id", "left")
    return catalog.missing_rows(j, _FIELDS, "doc_id", F.lit(1)).drop("rows")


@query(
    """SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL"""
)
def status_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.counters(orders(spark, sf_dir), ["o_orderstatus", "o_orderpriority"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY ALL")
def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY (l_returnflag = 'R'), l_quantity DESC, l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM r WHERE n = 1"""
)
def argmax_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir).select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return catalog.preferred(rows, ["l_partkey"], [F.col("l_returnflag") == "R", F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber")]).drop("l_returnflag")


@query("SELECT l_partkey, count(DISTINCT (l_quantity, l_discount)) AS n_contents FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey HAVING count(DISTINCT (l_quantity, l_discount)) > 1")
def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ambiguous(lineitem(spark, sf_dir), "l_partkey", ["l_quantity", "l_discount"], F.col("l_returnflag") == "N")


BLOCKED = """WITH s AS (SELECT text FROM documents GROUP BY text HAVING count(*) > 1),
b AS (SELECT d.doc_id, concat_ws(',', CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN s.text IS NOT NULL THEN 'shared_text' END, CASE WHEN n_chars < 200 THEN 'too_short' END) AS blockers
      FROM documents d LEFT JOIN s ON d.text = s.text)"""


@query(f"{BLOCKED} SELECT doc_id, blockers = '' AS ready, blockers FROM b")
def readiness_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "n_chars", "lang", hashing.sha256(F.col("text")).alias("h"))
    shared = catalog.quarantined(d, "h", "doc_id")
    found = catalog.blockers({"too_short": F.col("n_chars") < 200, "shared_text": F.col("shared"), "foreign": F.col("lang") != "en"})
    return shared.select("doc_id", (F.size(found) == 0).alias("ready"), F.array_join(found, ",").alias("blockers"))


@query(
    """WITH a AS (SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS k FROM part),
e AS (SELECT DISTINCT lower(replace(p_name, ' ', '_')) AS key, p_brand FROM part WHERE p_partkey % 3 <> 0),
c AS (SELECT replace(key, '_', '') AS compact, min(key) AS key FROM e GROUP BY 1 HAVING count(DISTINCT key) = 1),
m AS (SELECT a.p_partkey, 1 AS priority, min(e.p_brand) AS found FROM a JOIN e ON e.key = a.k || '_x' GROUP BY 1
      UNION ALL SELECT a.p_partkey, 2, min(e.p_brand) FROM a JOIN e ON e.key = a.k GROUP BY 1
      UNION ALL SELECT a.p_partkey, 3, min(e.p_brand) FROM a JOIN c ON c.compact = replace(a.k, '_', '') JOIN e ON e.key = c.key GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY priority) AS n FROM m)
SELECT p.p_partkey, r.priority::BIGINT AS priority, r.found FROM part p LEFT JOIN r ON p.p_partkey = r.p_partkey AND n = 1"""
)
def priority_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part(spark, sf_dir)
    key = F.lower(F.replace("p_name", F.lit(" "), F.lit("_")))
    asked = p.select("p_partkey", key.alias("k"))
    index = p.where("p_partkey % 3 != 0").select(key.alias("key"), "p_brand").groupBy("key").agg(F.min("p_brand").alias("found"))
    single = index.groupBy(T.compact(F.col("key")).alias("compact")).agg(F.count("*").alias("forms"), F.min("found").alias("found")).where("forms = 1")
    ways = [(1, asked.withColumn("key", F.concat("k", F.lit("_x"))).join(index, "key")), (2, asked.withColumnRenamed("k", "key").join(index, "key")), (3, asked.withColumn("compact", T.compact(F.col("k"))).join(single, "compact"))]
    every = None
    for n, found in ways:
        one = found.select("p_partkey", F.lit(n).cast("bigint").alias("priority"), "found")
        every = one if every is None else every.unionByName(one)
    first = every.groupBy("p_partkey").agg(F.min(F.struct("priority", "found")).alias("b"))
    return asked.select("p_partkey").join(first, "p_partkey", "left").select("p_partkey", "b.priority", "b.found")


@query(
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'website' WHEN l.doc_id IS NULL THEN 'official' ELSE 'both' END AS origin, l.quality, l.toxic
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id"""
)
def catalog_merge_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.merged(documents(spark, sf_dir).select("doc_id", "lang"), labels(spark, sf_dir), "doc_id")
    return found.select("doc_id", "origin", "website_snapshot.quality", "website_snapshot.toxic")


@query(
    """WITH h AS (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT doc_id) = 1)
SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 AND l.toxic = 0 AND n_chars >= 200 AND d.text IN (SELECT text FROM h)"""
)
def recovery_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "n_chars", hashing.sha256(F.col("text")).alias("h"))
    sole = catalog.sole_owners(d.select("h", "doc_id"), "h", "doc_id").select("h")
    good = labels(spark, sf_dir).where("quality = 1 and toxic = 0")
    return d.where("n_chars >= 200").join(good, "doc_id", "left_semi").join(sole, "h", "left_semi").select("doc_id")


@query("WITH s AS (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT doc_id) > 1) SELECT doc_id, text IN (SELECT text FROM s) AS shared FROM documents")
def quarantine_shared_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", hashing.sha256(F.col("text")).alias("h"))
    return catalog.quarantined(d, "h", "doc_id").select("doc_id", "shared")


@query(
    """SELECT 'missing_prediction' AS code, o_custkey::VARCHAR AS key FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'extra_prediction', c_custkey::VARCHAR FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
)
def coverage_anti_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = orders(spark, sf_dir).select(F.col("o_custkey").alias("k")).distinct()
    return evaluate.coverage(asked, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k", "missing_prediction", "extra_prediction")


@query(
    """SELECT 'unknown_part' AS code, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
UNION ALL SELECT 'unknown_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"""
)
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = lineitem(spark, sf_dir)
    known = part(spark, sf_dir).where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    placed = orders(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"))
    count = lambda key, side, code: li.join(side, key, "left_anti").agg(F.lit(code).alias("code"), F.count("*").alias("n"))
    return count("l_partkey", known, "unknown_part").unionByName(count("l_orderkey", placed, "unknown_order"))


@query(
    """WITH a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS place_a, row_number() OVER (ORDER BY ts, event_id) AS place_b FROM events)
SELECT event_id, place_a, place_b FROM a WHERE place_a <> place_b"""
)
def order_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "ts")
    a = e.select("event_id", F.col("event_id").alias("position"))
    b = e.select("event_id", F.struct("ts", "event_id").alias("position"))
    left = evaluate.places(a, "position").select("event_id", F.col("place").alias("place_a"))
    return left.join(evaluate.places(b, "position").select("event_id", F.col("place").alias("place_b")), "event_id").where("place_a != place_b")


NAMES = "names AS (SELECT p_brand, p_name, min(p_partkey) AS id, list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+'))) AS t FROM part GROUP BY ALL)"
PAIRS = f"""{NAMES}, pairs AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) AS common,
  len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS score FROM names a JOIN names b ON a.p_brand = b.p_brand AND a.id < b.id)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar names within a brand; each name stands once, for its least part."""
    names = part(spark, sf_dir).groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("id"))
    return graph.similar_pairs(names, "id", "p_brand", F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z0-9]+)")), 0.3, 1)


@query(f"WITH {PAIRS} SELECT a, b, round(score, 6) AS score, common FROM pairs WHERE common >= 1 AND score >= 0.3")
def jaccard_self_join_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {PAIRS}, ways AS (SELECT a AS src, b AS dst, score FROM pairs WHERE common >= 1 AND score >= 0.3 UNION ALL SELECT b, a, score FROM pairs WHERE common >= 1 AND score >= 0.3),
r AS (SELECT src, dst, round(score, 6) AS score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM ways)
SELECT src, dst, score, 'similar_name' AS reasons, rank FROM r WHERE rank <= 4"""
)
def confusion_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).withColumn("reason", F.lit("similar_name"))
    return graph.bounded_neighbours(pairs, 4).withColumns({"score": F.round("score", 6), "reasons": F.array_join("reasons", ",")})


COMPONENTS = """WITH RECURSIVE k AS (SELECT doc_id, 't' || sha256(coalesce(text, '')) AS key FROM documents UNION ALL SELECT doc_id, 'l' || sha256(split_part(text, chr(10), 1)) FROM documents WHERE text IS NOT NULL),
e AS (SELECT key, min(doc_id) AS least FROM k GROUP BY key),
links AS (SELECT DISTINCT doc_id AS a, least AS b FROM k JOIN e USING (key) WHERE doc_id <> least),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.a WHERE r.root < e.b),
comp AS (SELECT a AS doc_id, min(root) AS component FROM reach GROUP BY a)"""


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    first = F.when(F.col("text").isNotNull(), hashing.sha256(F.substring_index("text", "\n", 1)))
    return graph.components_by_keys(d, "doc_id", [hashing.sha256(F.coalesce("text", F.lit(""))), first])


@query(f"{COMPONENTS} SELECT doc_id, component FROM comp")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir)


@query(
    f"""{COMPONENTS}, s AS (SELECT component, ('0x' || left(sha256('seed' || chr(0) || min(doc_id)::VARCHAR), 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS v FROM comp GROUP BY component)
SELECT component, CASE WHEN v < 0.8 THEN 'train' WHEN v < 0.9 THEN 'validation' ELSE 'test' END AS split FROM s"""
)
def component_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _components(spark, sf_dir)
    least = c.groupBy("component").agg(F.min("doc_id").alias("k")).select("component", F.col("k").cast("string").alias("key"), F.lit(None).cast("string").alias("split"))
    return graph.component_splits(least, {"train": 0.8, "validation": 0.1, "test": 0.1}, "seed").select("component", "split")


@query(
    """WITH s AS (SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split, sha256(coalesce(text, '')) AS text, sha256(split_part(coalesce(text, ''), chr(10), 1)) AS line FROM documents),
u AS (SELECT split, unnest(['line', 'text']) AS kind, unnest([line, text]) AS key FROM s)
SELECT kind, key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM u GROUP BY kind, key HAVING count(DISTINCT split) > 1"""
)
def split_leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    d = documents(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test"))
    return graph.leaks(d, "split", {"line": hashing.sha256(F.substring_index(text, "\n", 1)), "text": hashing.sha256(text)}).withColumn("splits", F.array_join("splits", ","))


@query("SELECT doc_id, ('0x' || left(sha256(doc_id::VARCHAR), 8))::UBIGINT::DOUBLE / 4294967295.0::DOUBLE < 0.2 AS held_out FROM documents")
def hash_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", hashing.holdout(F.col("doc_id").cast("string"), 0.2).alias("held_out"))


ITEMS = "items AS (SELECT p_brand, p_name, p_type, min(p_partkey) AS id, list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+'))) AS g FROM part GROUP BY ALL)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part(spark, sf_dir).groupBy("p_brand", "p_name", "p_type").agg(F.min("p_partkey").alias("id")).withColumn("g", F.array_distinct(F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z0-9]+)"))))


@query(
    f"""WITH {ITEMS}, s AS (SELECT q.id AS query, i.id AS item, CASE WHEN q.p_type = i.p_type THEN 2.0::DOUBLE ELSE 0 END + 3.0::DOUBLE * len(list_intersect(q.g, i.g)) / greatest(len(list_distinct(list_concat(q.g, i.g))), 1) AS score,
  CASE WHEN q.p_type = i.p_type THEN 'type' || CASE WHEN len(list_intersect(q.g, i.g)) > 0 THEN ',' ELSE '' END ELSE '' END || CASE WHEN len(list_intersect(q.g, i.g)) > 0 THEN 'name' ELSE '' END AS reasons
  FROM items q JOIN items i ON q.id % 50 = 0 AND q.id <> i.id AND q.p_brand <> i.p_brand),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM s WHERE reasons <> '')
SELECT query, item, round(score, 6) AS score, reasons, rank FROM r WHERE rank <= 4"""
)
def analog_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = written(_items(spark, sf_dir), "items")
    rules = [("type", F.col("p_type"), 2.0), ("name", F.col("g"), 3.0)]
    found = recommend.analogues(items, items.where("id % 50 = 0"), "id", rules, "p_brand", 4)
    return found.withColumns({"score": F.round("score", 6), "reasons": F.array_join("reasons", ",")})


_SCORES = " ".join(f"WHEN dish = '{d}' AND style = '{s}' THEN {n}" for d, scores in recommend.PAIRING.items() for s, n in zip(recommend.STYLE_KEYS, scores, strict=True))
PAIRED = f"""d AS (SELECT unnest(['steak', 'grilled salmon', 'chocolate cake', 'mushroom salad', 'thai curry', 'bread']) AS asked, unnest(['red_meat', 'fish', 'dessert', 'vegetables', 'spicy', 'general']) AS dish),
s AS (SELECT p_partkey, p_type, ['red', 'white', 'rose', 'sparkling', 'sweet'][1 + p_size % 5] AS style FROM part),
p AS (SELECT p_partkey, asked, dish, style, CASE {_SCORES} ELSE 1 END AS score FROM s, d)"""
DISHES = ["steak", "grilled salmon", "chocolate cake", "mushroom salad", "thai curry", "bread"]


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.element_at(F.array(*map(F.lit, recommend.STYLE_KEYS)), (F.col("p_size") % 5 + 1).cast("int"))
    rows = part(spark, sf_dir).select("p_partkey", "p_brand", style.alias("style"), F.explode(F.array(*map(F.lit, DISHES))).alias("asked"))
    return rows.withColumn("dish", recommend.dish(F.col("asked"))).withColumn("score", recommend.pairing_score(F.col("dish"), F.col("style")))


@query(f"WITH {PAIRED} SELECT p_partkey, asked, dish, style, score::BIGINT AS score, CASE WHEN score >= 4 THEN 'excellent' WHEN score = 3 THEN 'good' WHEN score = 2 THEN 'acceptable' ELSE 'not_ideal' END AS verdict FROM p")
def pairing_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).select("p_partkey", "asked", "dish", "style", F.col("score").cast("bigint").alias("score"), recommend.verdict(F.col("score"), F.lit(True)).alias("verdict"))


@query(
    f"""WITH {ITEMS}, s AS (SELECT id, p_brand, ['red', 'white', 'rose', 'sparkling', 'sweet'][1 + id % 5] AS style, g FROM items),
v AS (SELECT *, CASE style WHEN 'red' THEN 1 WHEN 'white' THEN 4 WHEN 'rose' THEN 3 WHEN 'sparkling' THEN 3 ELSE 0 END AS score FROM s),
pool AS (SELECT q.id AS query, i.id AS item, i.score, q.score AS own, i.p_brand = q.p_brand AS same,
  row_number() OVER (PARTITION BY q.id ORDER BY round(3.0::DOUBLE * len(list_intersect(q.g, i.g)) / greatest(len(list_distinct(list_concat(q.g, i.g))), 1), 9) DESC, i.id) AS place
  FROM v q JOIN v i ON q.id % 50 = 0 AND q.id <> i.id AND len(list_intersect(q.g, i.g)) > 0),
k AS (SELECT *, CASE WHEN score > own THEN 0 WHEN score >= greatest(own, 3) AND NOT same THEN 1 END AS kind FROM pool WHERE place <= 60),
m AS (SELECT *, min(kind) OVER (PARTITION BY query) AS least FROM k WHERE kind IS NOT NULL),
r AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY place) AS rank, CASE kind WHEN 0 THEN 'better' ELSE 'same' END AS why FROM m WHERE kind = least)
SELECT * FROM r WHERE rank <= 3"""
)
def better_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = written(_items(spark, sf_dir), "items")
    style = F.element_at(F.array(*map(F.lit, recommend.STYLE_KEYS)), (F.col("id") % 5 + 1).cast("int"))
    scored = items.select("id", "p_brand", recommend.pairing_score(F.lit("fish"), style).alias("score"))
    pool = recommend.analogues(items, items.where("id % 50 = 0"), "id", [("name", F.col("g"), 3.0)], None, 60).select("query", "item", F.col("rank").alias("place"))
    of = lambda p: scored.select(F.col("id").alias(p), F.col("score").alias(f"{p}_score"), F.col("p_brand").alias(f"{p}_brand"))
    told = pool.join(of("query"), "query").join(of("item"), "item")
    rows = told.select("query", "item", "place", F.col("item_score").alias("score"), F.col("query_score").alias("own_score"), F.lit(True).alias("fits"), (F.col("item_brand") == F.col("query_brand")).alias("same_maker"))
    return recommend.alternatives(rows)


@query(r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS script FROM pages""")
def html_payload_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda name, attributes: F.regexp_extract("html", f"(?s)<{name}{attributes}>(.*?)</{name}>", 1)
    return pages(spark, sf_dir).select("page_id", tag("title", "").alias("title"), tag("script", "[^>]*").alias("script"))


@query(
    """WITH f AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events)
SELECT 'error' AS level, 'invalid_latency' AS code, event_id::VARCHAR AS key FROM f WHERE value < 10
UNION ALL SELECT 'error', 'duplicate_prediction', event_id::VARCHAR FROM f WHERE nth > 1
UNION ALL SELECT 'error', 'unknown_predicted_slug', event_id::VARCHAR FROM f WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
UNION ALL SELECT 'warning', 'candidate_top1_mismatch', event_id::VARCHAR FROM f WHERE event_type LIKE 'c%' AND value > 100"""
)
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    known = read(spark, sf_dir, "customer").where("c_custkey % 10 != 0").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known"))
    rows = e.withColumn("nth", nth).join(known, "user_id", "left")
    checks = {"invalid_latency": F.col("value") < 10, "duplicate_prediction": F.col("nth") > 1, "unknown_predicted_slug": F.col("known").isNull(), "candidate_top1_mismatch": F.col("event_type").like("c%") & (F.col("value") > 100)}
    return validate.issues(rows, checks, F.col("event_id"), F.lit(None)).select("level", "code", F.col("query_id").alias("key"))


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM conversations WHERE role = 'system')")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role").withColumn("key", F.struct("conv_id", "turn"))
    return sinks.remaining(c, c.where("role = 'system'").select("key"), "key").drop("key")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.percentiles(events(spark, sf_dir), "value", ["event_type"]).withColumns({"p50": F.round("p50", 6), "p95": F.round("p95", 6)})


@query("SELECT event_type, list_sort(list(value))[floor(0.95 * (count(*) - 1))::BIGINT + 1] AS p95, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type")
def floor_index_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.floor_rank(events(spark, sf_dir), "value", ["event_type"])


SLICED = "r AS (SELECT lang AS grp, quality AS expected, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS predicted FROM documents JOIN labels USING (doc_id))"


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "lang", "n_chars").join(labels(spark, sf_dir), "doc_id")
    return rows.select("lang", F.col("quality").alias("expected"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("predicted"))


@query(f'WITH {SLICED} SELECT grp AS "group", count(*) AS n, round(avg((expected = predicted)::INT::DOUBLE), 6) AS accuracy, count(DISTINCT expected) AS n_expected, count(DISTINCT expected) >= 2 AS hard FROM r GROUP BY grp')
def grouped_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.slices(_sliced(spark, sf_dir), "lang").withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {SLICED}, h AS (SELECT grp FROM r GROUP BY grp HAVING count(DISTINCT expected) >= 2) SELECT count(*) AS n, round(avg((expected = predicted)::INT::DOUBLE), 6) AS accuracy FROM r WHERE grp IN (SELECT grp FROM h)")
def hard_negative_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sliced(spark, sf_dir)
    hard = evaluate.slices(rows, "lang").where("hard").select(F.col("group").alias("lang"))
    return rows.join(hard, "lang", "left_semi").agg(F.count("*").alias("n"), F.round(F.avg((F.col("expected") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def content_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", hashing.sha256(F.coalesce("text", F.lit(""))).alias("sha256"))


@query("SELECT l_orderkey AS \"group\", array_to_string(list_sort(list(DISTINCT l_returnflag)), '') AS differing FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT l_returnflag) > 1")
def differing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.differing_fields(lineitem(spark, sf_dir), "l_orderkey", ["l_returnflag"]).where(F.size("fields") > 0).select("l_orderkey")
    flags = lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("differing"))
    return found.join(flags, "l_orderkey").withColumnRenamed("l_orderkey", "group")
