"""Further audits and measures on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quercus.functions import hashing
from quercus.functions import text as T
from quercus.functions.tables import read
from quercus.operators import catalog, evaluate, fit, graph, rank, vectors
from quercus.plans.catalogue import BLOCKED, NAMES, PAIRS, _pairs
from quercus.plans.registry import query
from quercus.plans.retrieval import POOLED, SCORES, SOFTMAX, _labelled, _pooled, _probabilities


@query(
    """WITH r AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'missing' WHEN quality = 0 THEN 'not_ready' WHEN n_chars IS NULL THEN 'unreadable' WHEN n_chars < 300 THEN 'too_small'
  WHEN count(*) OVER (PARTITION BY text) > 1 THEN 'conflicting_bytes' END AS reason FROM documents LEFT JOIN labels USING (doc_id))
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1"""
)
def reference_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.select(
        F.col("doc_id").cast("string").alias("slug"), hashing.sha256("text").alias("sha256"), F.when(F.coalesce("text", F.lit("")) != "", F.lit("a/b.txt")).alias("image_path"),
        (F.coalesce("quality", F.lit(1)) != 0).alias("index_ready"), F.col("n_chars").alias("width"), F.col("n_chars").alias("height"),
    )
    return catalog.reference_reasons(rows, 300).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    """SELECT sha256(text) AS source_sha256, min(source) AS slug, count(DISTINCT source) AS n_slugs, count(*) AS n_rows,
CASE WHEN bool_or(doc_id % 97 = 0) THEN 'hash_mismatch' WHEN count(DISTINCT source) > 1 THEN 'conflicting_labels' END AS issue FROM documents GROUP BY text"""
)
def source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hashing.sha256("text")
    rows = read(spark, sf_dir, "documents").select(h.alias("source_sha256"), F.when(F.col("doc_id") % 97 == 0, "0").otherwise(F.upper(h)).alias("declared_sha256"), F.col("source").alias("slug"))
    return catalog.merged_sources(rows)


@query(f"{BLOCKED} SELECT b.doc_id FROM b JOIN documents d ON b.doc_id = d.doc_id WHERE b.blockers <> CASE WHEN lang <> 'en' THEN 'foreign' ELSE '' END")
def metadata_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", hashing.sha256("text").alias("h"))
    shared = catalog.quarantined(d, "h", "doc_id")
    computed = shared.select("doc_id", catalog.blockers({"too_short": F.col("n_chars") < 200, "shared_text": F.col("shared"), "foreign": F.col("lang") != "en"}).alias("b"))
    declared = d.select("doc_id", F.when(F.col("lang") != "en", F.array(F.lit("foreign"))).alias("b"))
    return catalog.changed_metadata(declared, computed, "doc_id", ["b"])


@query(
    f"""WITH {PAIRS}, p AS (SELECT * FROM pairs WHERE common >= 1 AND score >= 0.3), c AS (SELECT a FROM p UNION SELECT b FROM p)
SELECT (SELECT count(*) FROM names) AS items, (SELECT count(*) FROM c) AS covered, round((SELECT count(*) FROM c)::DOUBLE / (SELECT count(*) FROM names), 6) AS fraction, (SELECT count(*) FROM p) AS similar_name"""
)
def cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("id"))
    found = graph.cluster_report(names, _pairs(spark, sf_dir).withColumn("reason", F.lit("similar_name")), "id")
    return found.select("items", "covered", "fraction", F.col("by_reason")["similar_name"].alias("similar_name"))


@query(
    f"""WITH {NAMES}, k AS (SELECT id, p_brand || '|' || t[1] AS bucket FROM names), s AS (SELECT bucket, count(*) AS n FROM k GROUP BY bucket)
SELECT 'oversized' AS kind, count(*) AS n FROM s WHERE n > 3 UNION ALL SELECT 'pairs', coalesce(sum(n * (n - 1) / 2), 0)::BIGINT FROM s WHERE n BETWEEN 2 AND 3"""
)
def oversized_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("id"))
    first = F.get(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z0-9]+)")))), 0)
    bucket = F.concat_ws("|", "p_brand", first)
    over = graph.oversized_buckets(names, "id", bucket, 3).agg(F.lit("oversized").alias("kind"), F.count("*").alias("n"))
    return over.unionByName(graph.bucket_pairs(names, "id", bucket, 1.0, "same_start", 3).agg(F.lit("pairs").alias("kind"), F.count("*").alias("n")))


@query(
    f"""WITH {SOFTMAX}, s AS (SELECT (p1 * 10)::DOUBLE AS p, (best % 3 <> 0)::INT AS label FROM best), t AS (SELECT unnest(range(1, 20)) AS step)
SELECT step / 20.0::DOUBLE AS threshold, round((SELECT count(*) FROM s WHERE label = 1 AND least(floor(p * 20), 19) >= step)::DOUBLE / (SELECT count(*) FROM s WHERE label = 1), 6) AS kept,
       round(1 - (SELECT count(*) FROM s WHERE label = 0 AND least(floor(p * 20), 19) >= step)::DOUBLE / nullif((SELECT count(*) FROM s WHERE label = 0), 0), 6) AS rejected FROM t"""
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = rank.margins(_probabilities(spark, sf_dir), tie="item_id")
    scored = best.select((F.col("p1") * 10).alias("p"), (F.col("best") % 3 != 0).cast("int").alias("label"))
    return fit.threshold_sweep(scored, 19).select("threshold", F.round("kept", 6).alias("kept"), F.round("rejected", 6).alias("rejected"))


@query(
    f"""WITH {POOLED}, t AS (SELECT query_id, any_value(expected) AS expected, min(rank) FILTER (label = expected) AS place FROM places GROUP BY query_id)
SELECT expected % 3 AS scene, count(*) AS n, count(*) FILTER (place = 1) AS top1, count(*) FILTER (place <= 5) AS top5 FROM t GROUP BY 1"""
)
def retrieval_by_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected"))
    own = _pooled(spark, sf_dir).join(truth, "query_id").where("label = expected").select("query_id", F.col("rank").alias("place"))
    return evaluate.retrieval_by_scene(truth.join(own, "query_id", "left").withColumn("scene", F.col("expected") % 3))


@query(
    f"""WITH {SCORES}, s AS (SELECT query_id, item_id, (score * 100)::INT AS inliers, score, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS next, rank FROM ranked WHERE rank <= 5)
SELECT query_id, item_id AS slug, round(least(0.94::DOUBLE, 0.76::DOUBLE + 0.18::DOUBLE * (score - next) / greatest(score, 1e-9)), 5) AS confidence FROM s WHERE rank = 1 AND next IS NOT NULL AND inliers >= 10 AND (score - next) / greatest(score, 1e-9) >= 0.02"""
)
def strong_match_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _labelled(spark, sf_dir, 5).select("query_id", F.col("item_id").alias("slug"), F.round(F.col("score") * 100).cast("int").alias("inliers"), "score")
    return rank.strong_match(found, 10, 0.02).withColumn("confidence", F.round("confidence", 5))


@query(
    """WITH e AS (SELECT event_id, event_type AS expected, CASE WHEN user_id % 4 <> 0 THEN CASE WHEN user_id % 3 = 0 THEN 'click' ELSE event_type END END AS predicted, value FROM events)
SELECT count(*) AS n, count(expected) AS labelled, count(predicted) AS predicted, count(*) FILTER (expected = predicted) AS matched, count(*) FILTER (predicted IN (SELECT event_type FROM events)) AS known,
       count(*) FILTER (value >= 0) AS schema_valid, count(*) FILTER (event_id % 2 = 0) AS checked FROM e"""
)
def validation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    known = e.select(F.col("event_type").alias("predicted")).distinct().withColumn("known", F.lit(True))
    predicted = F.when(F.col("user_id") % 4 != 0, F.when(F.col("user_id") % 3 == 0, "click").otherwise(F.col("event_type")))
    rows = e.withColumn("predicted", predicted).join(known, "predicted", "left")
    return evaluate.totals(rows.select(F.col("event_type").alias("expected"), "predicted", F.coalesce("known", F.lit(False)).alias("known"), (F.col("value") >= 0).alias("valid"), (F.col("event_id") % 2 == 0).alias("checked")))


@query(
    f"""WITH {POOLED}, c AS (SELECT query_id, any_value(expected) AS expected, list(label ORDER BY rank) FILTER (rank <= 5) AS candidates, max(score) AS best FROM places GROUP BY query_id),
s AS (SELECT *, expected <> 0 AS is_known, CASE WHEN best >= 0.5 THEN 'found' ELSE 'not_found' END AS status FROM c)
SELECT count(*) FILTER (is_known) AS known, count(*) FILTER (is_known AND candidates[1] = expected) AS top1, count(*) FILTER (is_known AND list_contains(candidates, expected)) AS top5,
       count(*) FILTER (is_known AND status = 'found') AS found_known, count(*) FILTER (is_known AND status = 'found' AND candidates[1] = expected) AS found_right,
       count(*) FILTER (is_known AND status = 'not_found') AS wrong_not_found, count(*) FILTER (NOT is_known) AS unknown, count(*) FILTER (NOT is_known AND status = 'not_found') AS rejected,
       count(*) FILTER (NOT is_known AND status = 'found') AS wrong_found FROM s"""
)
def known_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected"))
    top = _pooled(spark, sf_dir).where("rank <= 5").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("candidates"), F.max("score").alias("best"))
    accepted = F.when(F.col("expected") != 0, F.array("expected")).otherwise(F.array().cast("array<int>"))
    rows = truth.join(top, "query_id").select(accepted.alias("accepted"), "candidates", F.when(F.col("best") >= 0.5, "found").otherwise("not_found").alias("status"))
    return evaluate.known_unknown(rows)


@query("SELECT source AS slug, max(doc_id) AS doc_id, max_by(lang, doc_id) AS lang FROM documents GROUP BY source")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.last_of(read(spark, sf_dir, "documents").select(F.col("source").alias("slug"), "doc_id", "lang"), "slug", "doc_id")


@query("SELECT 1000::BIGINT AS expected, count(DISTINCT source) AS fetched, count(*) - count(DISTINCT source) AS duplicates, count(*) FILTER (lang = 'fr') AS failed, count(DISTINCT source) = 1000 AS complete FROM documents")
def snapshot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").withColumn("status", F.when(F.col("lang") == "fr", "failed").otherwise("ok"))
    return catalog.snapshot_report(rows, 1000, "source")


@query(
    """WITH q AS (SELECT c_custkey AS id, lower(c_mktsegment) AS alias, c_nationkey AS slug FROM customer), k AS (SELECT n_nationkey AS slug FROM nation WHERE n_nationkey < 20),
m AS (SELECT alias FROM q GROUP BY alias HAVING count(DISTINCT slug) > 1)
SELECT issue, count(*) AS n FROM (SELECT 'missing_target' AS issue FROM q WHERE slug NOT IN (SELECT slug FROM k) UNION ALL SELECT 'alias_collision' FROM q WHERE alias IN (SELECT alias FROM m)) GROUP BY issue"""
)
def alias_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("slug"), F.col("c_mktsegment").alias("alias"))
    known = read(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("slug"))
    return catalog.alias_issues(aliases, known).groupBy("issue").agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, (path <> '' AND NOT regexp_matches(path, '(^|/)\\.\\.(/|$)') AND octet_length(encode(path)) <= 240) AS safe FROM p"""
)
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1)
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path"), T.safe_path(path).alias("safe"))


@query(
    f"""WITH {SCORES}, best AS (SELECT query_id, item_id, score FROM ranked WHERE rank = 1)
SELECT query_id, item_id AS slug, CASE WHEN score >= 0.5 THEN 'strong' ELSE 'visual' END AS method FROM best"""
)
def cascade_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _labelled(spark, sf_dir, 1).select("query_id", F.col("item_id").alias("slug"), F.col("score").alias("confidence"))
    return rank.cascade(best, [("strong", best.where("confidence >= 0.5")), ("visual", best)]).select("query_id", "slug", "method")


@query("SELECT min(doc_id) AS first, count(*) AS n FROM documents GROUP BY text")
def once_by_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), hashing.sha256(F.coalesce("text", F.lit(""))).alias("payload_sha256"))
    first, every = rank.once_by_payload(d)
    return first.select(F.col("query_id").alias("first")).join(every.groupBy("first").agg(F.count("*").alias("n")), "first")


@query()
def view_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum and mean over two views of a query: the vector and its projection on half of its parts."""
    import numpy as np

    e = read(spark, sf_dir, "embeddings")
    size = len(e.select("embedding").first()[0])
    half = np.diag([1.0] * (size // 2) + [0.0] * (size - size // 2))
    q = e.where("vec_id % 50 = 0")
    full = vectors.scores(q, e, 50, "vec_id", "vec_id").withColumn("pair", F.lit("full"))
    part = vectors.scores(vectors.projected(q.select("vec_id", "embedding"), half), e, 50, "vec_id", "vec_id").withColumn("pair", F.lit("half"))
    fused = vectors.view_scores(full.unionByName(part).withColumnRenamed("item_id", "slug"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("v_mean"), "slug"))).where("rank <= 5")
