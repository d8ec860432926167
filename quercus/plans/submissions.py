"""Validation of submissions, confusion groups, slices and audits of generated scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus.functions import text as T
from quercus.functions.tables import read, written
from quercus.operators import evaluate, graph, validate
from quercus.plans.registry import query

def _id() -> Column:
    return F.col("event_id")


def _text_id() -> Column:
    return _id().cast("string")


def _every(n: int, r: int) -> Column:
    return _id() % n == r


def _sha(prefix: str) -> Column:
    return F.sha2(F.concat(F.lit(prefix), _text_id()), 256)


def _files(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A manifest, predictions and what goes with them, made of all events; each kind of fault at rows of its own."""
    e = written(read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("t"), F.col("value").alias("v")), "events")
    text = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    file = text("img/", _text_id(), ".png")
    manifest = e.select(
        _id().alias("pos"),
        F.when(_every(97, 5), text("bad id ", _text_id())).when(_every(89, 7), text("q", (_id() - 1).cast("string"))).otherwise(text(" q", _text_id())).alias("query_id"),
        F.when(_every(101, 3), "  ").when(_every(103, 4), text("../x/", _text_id())).otherwise(file).alias("image_path"),
        F.when(_every(5, 0), "").when(_every(107, 1), "nowhere").otherwise(F.col("t")).alias("Label"),
        F.when(_every(109, 2), "zz").when(_every(113, 9), F.sha2(F.lit("other"), 256)).when(_every(4, 0), F.upper(_sha("c"))).alias("sha256"),
    )
    fields = F.array(*map(F.lit, validate.REQUIRED))
    one = lambda query_id, pos: (
        query_id.alias("query_id"), pos.alias("pos"), F.when(_every(151, 11), "").when(_every(157, 12), "img/other.png").otherwise(file).alias("image_path"),
        F.when(_every(163, 13), "nothex").when(_every(167, 14), F.sha2(F.lit("wrong"), 256)).otherwise(_sha("c")).alias("image_sha256"),
        F.when(_every(173, 15), "  ").when(~_every(7, 0), F.when(_every(179, 16), "mars").otherwise(F.col("t"))).alias("predicted_slug"),
        F.when(_every(181, 17), -1.0).when(_every(191, 18), float("nan")).otherwise(F.col("v")).alias("latency_ms"),
        F.when(_every(193, 19), text("mars| ", F.col("t"))).when(_every(2, 0), text(F.col("t"), "|view")).alias("candidates"),
        F.when(_every(197, 20), F.array_remove(fields, "latency_ms")).otherwise(fields).alias("fields"),
    )
    query_id = F.when(_every(149, 10), text("bad!", _text_id())).when(_every(139, 8), text("q", (_id() - 1).cast("string"))).otherwise(text("q", _text_id()))
    predictions = e.where(~_every(127, 0)).select(*one(query_id, F.when(_every(137, 6), 4 * _id() + 82).otherwise(4 * _id()))).unionByName(e.where(_every(131, 0)).select(*one(text("x", _text_id()), 4 * _id() + 1)))
    lists = e.where(_every(199, 21)).select((4 * _id()).alias("pos"), F.lit("bad id").alias("query_id"), F.lit("mars").alias("top_5"))
    for able, pos, name, names in ((_every(211, 22), 4 * _id(), "q", None), (_every(223, 23), 4 * _id(), "q", "mars"), (_every(223, 23), 4 * _id() + 1, "q", "click"), (_every(227, 24), 4 * _id(), "nope", "click")):
        lists = lists.unionByName(e.where(able).select(pos.alias("pos"), text(name, _text_id()).alias("query_id"), F.lit(names).cast("string").alias("top_5")))
    images = e.where(~_every(229, 25)).select(file.alias("path"), F.when(_every(233, 26), F.sha2(F.lit("changed"), 256)).otherwise(_sha("c")).alias("sha256"))
    checksums = e.where(~_every(239, 27)).select(text("data/", file).alias("path"), F.when(_every(241, 28), F.sha2(F.lit("old"), 256)).otherwise(_sha("c")).alias("sha256"))
    catalogue = e.select(F.col("t").alias("slug")).distinct()
    return {"manifest": manifest, "predictions": predictions, "candidates": lists, "images": images, "checksums": checksums, "catalogue": catalogue}


_CODE = "SELECT '{run}' AS run, '{level}' AS level, '{code}' AS code, {key}::VARCHAR AS query_id FROM {rows}"


def _codes(run: str, checks: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(_CODE.format(run=run, level=validate.LEVELS[code], code=code, key=key, rows=rows) for code, key, rows in checks)


_HEX = "'[0-9a-fA-F]{64}'"
_ID = "'[A-Za-z0-9._-]+'"
FILES = f"""e AS (SELECT event_id AS e, event_type AS t, value AS v FROM events), cat AS (SELECT DISTINCT t FROM e),
m0 AS (SELECT e AS pos, trim(CASE WHEN e % 97 = 5 THEN 'bad id ' || e WHEN e % 89 = 7 THEN 'q' || (e - 1) ELSE ' q' || e END) AS id,
  CASE WHEN e % 101 = 3 THEN '  ' WHEN e % 103 = 4 THEN '../x/' || e ELSE 'img/' || e || '.png' END AS path, CASE WHEN e % 5 = 0 THEN NULL WHEN e % 107 = 1 THEN 'nowhere' ELSE t END AS expected,
  CASE WHEN e % 109 = 2 THEN 'zz' WHEN e % 113 = 9 THEN sha256('other') WHEN e % 4 = 0 THEN upper(sha256('c' || e)) END AS declared FROM e),
m1 AS (SELECT *, regexp_full_match(id, {_ID}) AS ok_id, trim(path) <> '' AS ok_path FROM m0),
m AS (SELECT m1.*, f.first FROM m1 LEFT JOIN (SELECT id, min(pos) AS first FROM m1 WHERE ok_id AND ok_path GROUP BY id) f ON m1.id = f.id),
q AS (SELECT *, regexp_full_match(declared, {_HEX}) AS ok_declared, CASE WHEN regexp_full_match(declared, {_HEX}) THEN lower(declared) END AS q_sha FROM m WHERE ok_id AND pos = first),
p00 AS (SELECT *, CASE WHEN e % 149 = 10 THEN 'bad!' || e WHEN e % 139 = 8 THEN 'q' || (e - 1) ELSE 'q' || e END AS raw, CASE WHEN e % 137 = 6 THEN 4 * e + 82 ELSE 4 * e END AS pos FROM e WHERE e % 127 <> 0
  UNION ALL SELECT *, 'x' || e, 4 * e + 1 FROM e WHERE e % 131 = 0),
p0 AS (SELECT pos, regexp_full_match(raw, {_ID}) AS ok_id, CASE WHEN regexp_full_match(raw, {_ID}) THEN raw ELSE '__invalid_row_' || pos END AS id,
  CASE WHEN e % 151 = 11 THEN '' WHEN e % 157 = 12 THEN 'img/other.png' ELSE 'img/' || e || '.png' END AS path,
  CASE WHEN e % 163 = 13 THEN 'nothex' WHEN e % 167 = 14 THEN sha256('wrong') ELSE sha256('c' || e) END AS sha, e % 173 = 15 AS bad_slug,
  CASE WHEN e % 173 <> 15 AND e % 7 <> 0 THEN CASE WHEN e % 179 = 16 THEN 'mars' ELSE t END END AS predicted,
  CASE WHEN e % 197 = 20 OR e % 181 = 17 OR e % 191 = 18 OR v < 0 THEN NULL ELSE v END AS latency, e % 197 = 20 AS lacks,
  CASE WHEN e % 193 = 19 THEN ['mars', t] WHEN e % 2 = 0 THEN CASE WHEN t = 'view' THEN ['view'] ELSE [t, 'view'] END END AS embedded FROM p00),
p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth FROM p0),
c0 AS (SELECT 4 * e AS pos, 'bad id' AS id, ['mars'] AS names FROM e WHERE e % 199 = 21 UNION ALL SELECT 4 * e, 'q' || e, NULL FROM e WHERE e % 211 = 22 UNION ALL SELECT 4 * e, 'q' || e, ['mars'] FROM e WHERE e % 223 = 23
  UNION ALL SELECT 4 * e + 1, 'q' || e, ['click'] FROM e WHERE e % 223 = 23 UNION ALL SELECT 4 * e, 'nope' || e, ['click'] FROM e WHERE e % 227 = 24),
c1 AS (SELECT *, id <> 'bad id' AS ok_id FROM c0), c2 AS (SELECT id, min(pos) AS first FROM c1 WHERE ok_id AND names IS NOT NULL GROUP BY id),
c AS (SELECT c1.*, first FROM c1 LEFT JOIN c2 USING (id)), ext AS (SELECT id, names FROM c WHERE ok_id AND pos = first),
f AS (SELECT p.*, coalesce(ext.names, embedded) AS names FROM p LEFT JOIN ext ON p.id = ext.id WHERE nth = 1),
img AS (SELECT 'img/' || e || '.png' AS path, CASE WHEN e % 233 = 26 THEN sha256('changed') ELSE sha256('c' || e) END AS actual FROM e WHERE e % 229 <> 25),
lst AS (SELECT 'img/' || e || '.png' AS path, CASE WHEN e % 241 = 28 THEN sha256('old') ELSE sha256('c' || e) END AS listed FROM e WHERE e % 239 <> 27),
s AS (SELECT q.id, q.pos AS q_pos, f.pos AS p_pos, q.path, q.q_sha, q.expected, f.path AS p_path, f.sha, f.predicted, f.names, actual, listed, f.id IS NOT NULL AS matched
  FROM q LEFT JOIN f ON q.id = f.id LEFT JOIN img ON img.path = q.path LEFT JOIN lst ON lst.path = q.path),
o AS (SELECT row_number() OVER (ORDER BY q_pos) AS a, row_number() OVER (ORDER BY p_pos) AS b FROM s WHERE matched)"""
_CHECKS = _codes(
    "full",
    [
        ("invalid_query_id", "NULL", "m WHERE NOT ok_id"),
        ("duplicate_query_id", "id", "m WHERE ok_id AND pos > first"),
        ("invalid_image_path", "id", "m WHERE ok_id AND NOT ok_path AND coalesce(pos < first, true)"),
        ("unsafe_image_path", "id", "q WHERE path LIKE '../%'"),
        ("invalid_query_checksum", "id", "q WHERE NOT ok_declared"),
        ("unknown_expected_slug", "id", "q WHERE expected NOT IN (SELECT t FROM cat)"),
        ("invalid_candidate_query_id", "NULL", "c WHERE NOT ok_id"),
        ("missing_candidates", "id", "c WHERE ok_id AND names IS NULL"),
        ("duplicate_candidate_query_id", "id", "c WHERE ok_id AND names IS NOT NULL AND pos > first"),
        ("extra_candidate_query_id", "id", "ext WHERE id NOT IN (SELECT id FROM q)"),
        ("missing_prediction_field", "NULL", "p WHERE lacks"),
        ("invalid_prediction_query_id", "NULL", "p WHERE NOT ok_id"),
        ("duplicate_prediction", "id", "p WHERE nth > 1"),
        ("invalid_prediction_image_path", "id", "f WHERE path = ''"),
        ("invalid_prediction_checksum", "id", "f WHERE sha = 'nothex'"),
        ("invalid_predicted_slug", "id", "f WHERE bad_slug"),
        ("unknown_predicted_slug", "id", "f WHERE predicted NOT IN (SELECT t FROM cat)"),
        ("invalid_latency", "id", "f WHERE latency IS NULL"),
        ("unknown_candidate_slug", "id", "(SELECT id, unnest(names) AS name FROM f) WHERE name NOT IN (SELECT t FROM cat)"),
        ("missing_prediction", "id", "q WHERE id NOT IN (SELECT id FROM f)"),
        ("extra_prediction", "id", "f WHERE id NOT IN (SELECT id FROM q)"),
        ("prediction_order", "NULL", "(SELECT 1 FROM o WHERE a <> b LIMIT 1)"),
        ("image_path_mismatch", "id", "s WHERE matched AND p_path <> path"),
        ("image_missing", "id", "s WHERE matched AND actual IS NULL"),
        ("prediction_checksum_mismatch", "id", "s WHERE matched AND sha <> actual"),
        ("source_checksum_mismatch", "id", "s WHERE matched AND listed <> actual"),
        ("query_checksum_mismatch", "id", "s WHERE matched AND q_sha <> actual"),
        ("checksum_not_declared", "id", "s WHERE matched AND actual IS NOT NULL AND listed IS NULL"),
        ("candidate_top1_mismatch", "id", "s WHERE matched AND names[1] IS DISTINCT FROM predicted AND len(names) > 0"),
        ("partial_labels", "NULL", "(SELECT 1)"),
    ],
)
_BARE = _codes("unlabelled", [("catalog_not_provided", "NULL", "(SELECT 1)"), ("unlabeled_manifest", "NULL", "(SELECT 1)"), ("checksums_not_verified", "NULL", "(SELECT 1)")])
_EMPTY = _codes("empty", [("catalog_not_provided", "NULL", "(SELECT 1)"), ("unlabeled_manifest", "NULL", "(SELECT 1)"), ("empty_query_manifest", "NULL", "(SELECT 1)"), ("extra_prediction", "'q' || e", "e")])


@query(f"WITH {FILES}, every AS ({_CHECKS} UNION ALL {_BARE} UNION ALL {_EMPTY}) SELECT run, level, code, count(*) AS n, min(query_id) AS first, max(query_id) AS last FROM every GROUP BY ALL")
def submission_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All codes: of a submission with every fault, of one without labels and checksums, and of one against an empty manifest."""
    files = _files(spark, sf_dir)
    full = validate.validate(files["manifest"], files["predictions"], "pos", files["catalogue"], files["images"], files["checksums"], files["candidates"], "fields").issues
    e = read(spark, sf_dir, "events").select(_id().alias("pos"), F.concat(F.lit("q"), _text_id()).alias("query_id"), F.concat(F.lit("img/"), _text_id()).alias("image_path"), _sha("c").alias("image_sha256"), F.lit("x").alias("predicted_slug"), F.lit(1.0).alias("latency_ms"))
    asked = e.select("pos", "query_id", "image_path")
    bare, empty = validate.validate(asked, e, "pos").issues, validate.validate(asked.limit(0), e, "pos").issues
    every = full.withColumn("run", F.lit("full")).unionByName(bare.withColumn("run", F.lit("unlabelled"))).unionByName(empty.withColumn("run", F.lit("empty")))
    return every.groupBy("run", "level", "code").agg(F.count("*").alias("n"), F.min("query_id").alias("first"), F.max("query_id").alias("last"))


@query(
    f"""WITH {FILES}, k AS (SELECT s.*, p_path IS NOT NULL AND actual IS NOT NULL AS checked FROM s),
v AS (SELECT f.*, ok_id AND path <> '' AND sha <> 'nothex' AND NOT bad_slug AND NOT lacks AND latency IS NOT NULL AS valid FROM f)
SELECT unnest(['query_count', 'prediction_count', 'matched_count', 'missing_predictions', 'extra_predictions', 'null_predictions', 'known_non_null_predictions', 'predictions_with_candidates', 'checksums_checked', 'checksums_matched', 'schema_valid_predictions']) AS name,
  unnest([(SELECT count(*) FROM q), (SELECT count(*) FROM p), (SELECT count(*) FROM s WHERE matched), (SELECT count(*) FROM s WHERE NOT matched), (SELECT count(*) FROM f WHERE id NOT IN (SELECT id FROM q)), (SELECT count(*) FROM s WHERE matched AND predicted IS NULL),
    (SELECT count(*) FROM s WHERE matched AND predicted IN (SELECT t FROM cat)), (SELECT count(*) FROM s WHERE matched AND names IS NOT NULL), (SELECT count(*) FROM k WHERE checked), (SELECT count(*) FROM k WHERE checked AND sha = actual),
    (SELECT count(*) FROM v WHERE valid AND id IN (SELECT id FROM q))]) AS n"""
)
def submission_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    found = validate.validate(files["manifest"], files["predictions"], "pos", files["catalogue"], files["images"], files["checksums"], files["candidates"], "fields")
    names = ["query_count", "prediction_count", "matched_count", "missing_predictions", "extra_predictions", "null_predictions", "known_non_null_predictions", "predictions_with_candidates", "checksums_checked", "checksums_matched", "schema_valid_predictions"]
    return spark.createDataFrame([(n, found.totals[n]) for n in names], "name string, n bigint")


@query(
    f"""WITH {FILES}, r AS (SELECT expected, predicted, names, CASE WHEN q_pos % 3 = 0 THEN 'test' WHEN q_pos % 3 = 1 THEN 'train' END AS split, q_pos % 11 AS grp, q_pos % 6 = 0 AS flag FROM s WHERE expected IS NOT NULL),
sums AS (SELECT 'group' AS slice, grp::VARCHAR AS name, * FROM r UNION ALL SELECT 'split', split, * FROM r WHERE split IS NOT NULL UNION ALL SELECT 'explicit_hard_negative', NULL, * FROM r WHERE flag
  UNION ALL SELECT 'hard_negative', NULL, * FROM r WHERE grp IN (SELECT grp FROM r GROUP BY grp HAVING count(DISTINCT expected) >= 2)),
g AS (SELECT slice, name, count(*) AS queries, count(DISTINCT expected) AS classes, round(avg(coalesce(expected = predicted, false)::INT::DOUBLE), 3) AS accuracy, count(names) AS candidate_coverage,
  round(avg(CASE WHEN names IS NOT NULL THEN list_contains(names[1:5], expected)::INT::DOUBLE END), 3) AS recall_at_5 FROM sums GROUP BY ALL)
SELECT * FROM g UNION ALL SELECT 'macro_group', 'group_id', count(*), NULL, round(avg(accuracy), 3), NULL, NULL FROM g WHERE slice = 'group'"""
)
def submission_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    at = F.col("pos")
    manifest = files["manifest"].withColumns({"split": F.when(at % 3 == 0, "test").when(at % 3 == 1, "train"), "group_id": (at % 11).cast("string"), "hard_negative": F.when(at % 6 == 0, "yes")})
    found = validate.validate(manifest, files["predictions"], "pos", files["catalogue"], files["images"], files["checksums"], files["candidates"], "fields")
    return evaluate.all_slices(found.scored)


PARTS = """pt AS (SELECT p_partkey AS k, regexp_replace(p_name, ' ', '-', 'g') || '-' || p_partkey AS slug, p_size > 10 AS ready,
  regexp_extract_all(lower(p_brand), '[a-z0-9]+') AS w, list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: NOT regexp_full_match(x, '(19|20)[0-9]{2}')) AS n,
  list_filter(regexp_extract_all(lower(p_name || '-' || p_partkey), '[a-z0-9]+'), lambda x: NOT regexp_full_match(x, '(19|20)[0-9]{2}')) AS sw,
  list_sort(list_distinct(string_split(p_name || CASE WHEN p_size % 3 = 0 THEN ' oak' ELSE '' END, ' '))) AS g, [lower(p_type)] AS c FROM part),
r AS (SELECT * FROM pt WHERE ready),
x AS (SELECT *, list_filter(n, lambda t: NOT list_contains(g, t) AND NOT list_contains(c, t) AND NOT list_contains(w, t) AND NOT regexp_full_match(t, '[0-9]+')) AS series FROM r),
b AS (SELECT 'same_name_without_vintage' AS reason, w, n AS sig, slug FROM x WHERE len(n) > 0 UNION ALL SELECT 'same_slug_without_vintage', w, sw, slug FROM x WHERE len(sw) > 0
  UNION ALL SELECT 'same_grapes_category', w, list_concat(list_concat(g, ['|']), c), slug FROM x UNION ALL SELECT 'same_series_tokens', w, series, slug FROM x WHERE len(series) >= 2),
sized AS (SELECT reason, w, sig, list_sort(list(slug)) AS slugs FROM b GROUP BY ALL HAVING count(*) > 1),
t AS (SELECT slug, w, list_distinct(list_filter(n, lambda y: NOT list_contains(w, y))) AS n, list_distinct(list_filter(sw, lambda y: NOT list_contains(w, y))) AS sw FROM x),
near AS (SELECT l.w, l.slug AS a, r.slug AS b, len(list_intersect(l.n, r.n)) AS ni, len(list_distinct(list_concat(l.n, r.n))) AS nu, len(list_intersect(l.sw, r.sw)) AS si, len(list_distinct(list_concat(l.sw, r.sw))) AS su
  FROM t l JOIN t r ON l.w = r.w AND l.slug < r.slug),
cl AS (SELECT reason, w, sig, slugs FROM sized WHERE len(slugs) <= 20 UNION ALL SELECT 'near_name_tokens', w, [a, b], [a, b] FROM near WHERE ni >= 2 AND ni::DOUBLE / nu >= 0.65
  UNION ALL SELECT 'near_slug_tokens', w, [a, b], [a, b] FROM near WHERE si >= 2 AND si::DOUBLE / su >= 0.65),
ids AS (SELECT *, left(sha256('["' || reason || '",["' || array_to_string(w, '","') || '"],["' || array_to_string(sig, '","') || '"],["' || array_to_string(slugs, '","') || '"]]'), 20) AS cluster_id FROM cl),
each AS (SELECT reason, slugs, unnest(slugs) AS src FROM cl), pairs AS (SELECT reason, src, unnest(slugs) AS dst FROM each),
score AS (SELECT src, dst, max(CASE reason WHEN 'same_series_tokens' THEN 0.9 WHEN 'near_name_tokens' THEN 0.8 WHEN 'near_slug_tokens' THEN 0.75 WHEN 'same_grapes_category' THEN 0.6 ELSE 1.0 END)::DOUBLE AS score,
  array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM pairs WHERE src <> dst GROUP BY ALL),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM score) WHERE rank <= 16)"""


def _confusion(spark: SparkSession, sf_dir: str) -> graph.Confusion:
    p = read(spark, sf_dir, "part")
    grapes = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " oak").otherwise(""))
    rows = p.select(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string")).alias("slug"), F.col("p_name").alias("name"), F.col("p_brand").alias("winery"),
        F.replace(grapes, F.lit(" "), F.lit(", ")).alias("grapes"), F.col("p_type").alias("category"), (F.col("p_size") > 10).alias("index_ready"),
    )
    return graph.confusion(rows, max_group=20)


@query(f"WITH {PARTS} SELECT src, dst, score, reasons, rank FROM nb")
def confusion_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir).neighbours.withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {PARTS} SELECT cluster_id, reason, array_to_string(slugs, ',') AS slugs FROM ids")
def confusion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir).clusters.select("cluster_id", "reason", F.array_join("slugs", ",").alias("slugs"))


@query(
    f"""WITH {PARTS}, n AS (SELECT reason, count(*) AS n FROM cl GROUP BY reason), o AS (SELECT reason, count(*) AS n FROM sized WHERE len(slugs) > 20 GROUP BY reason)
SELECT (SELECT count(*) FROM r) AS eligible, (SELECT count(DISTINCT src) FROM nb) AS covered, round((SELECT count(DISTINCT src) FROM nb)::DOUBLE / (SELECT count(*) FROM r), 6) AS fraction, (SELECT count(*) FROM cl) AS clusters,
  (SELECT string_agg(reason || ':' || n, ',' ORDER BY reason) FROM n) AS by_reason, coalesce((SELECT string_agg(reason || ':' || n, ',' ORDER BY reason) FROM o), '') AS oversized, (SELECT count(*) FROM nb) AS directed_pairs"""
)
def confusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,bigint>")))), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return _confusion(spark, sf_dir).report.select("eligible", "covered", "fraction", "clusters", told("by_reason").alias("by_reason"), told("oversized").alias("oversized"), "directed_pairs")


SCENES = """o AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS part, l_quantity AS x, round(l_discount * 100) AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nth FROM lineitem),
sc AS (SELECT id, list({'slug': 's' || (part % 40), 'src': sha256('p' || part), 'x': x, 'y': y, 'is': nth = 1} ORDER BY nth) FILTER (nth <= 3) AS objects FROM o GROUP BY id),
j AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 17 = 0 THEN 'dev' WHEN o_custkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN o_orderkey % 31 = 0 THEN 'other' ELSE sc.objects[1].slug END AS expected, sha256('p' || o_orderkey) AS src,
  CASE WHEN o_orderkey % 2 = 0 THEN 'shelf' ELSE 'single' END AS scene, sc.objects, o_orderkey % 13 AS k, CASE WHEN o_custkey % 5 <> 0 THEN 'f' || o_custkey END AS family FROM orders JOIN sc ON o_orderkey = sc.id),
lab AS (SELECT *, len(list_filter(objects, lambda b: b.is)) = 1 AND list_filter(objects, lambda b: b.is)[1].slug = expected AS labelled FROM j)"""


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    li = read(spark, sf_dir, "lineitem")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    x, y, part = F.col("l_quantity"), F.round(F.col("l_discount") * 100), F.col("l_partkey")
    box = F.struct(F.concat(F.lit("s"), (part % 40).cast("string")).alias("slug"), F.sha2(F.concat(F.lit("p"), part.cast("string")), 256).alias("source_sha256"), F.array(x - 5, y - 5, x + 5, y + 5).alias("bbox_xyxy"), (F.col("nth") == 1).alias("is_target"))
    objects = li.withColumn("nth", nth).where("nth <= 3").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", box.alias("b")))), lambda s: s["b"]).alias("objects"))
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return read(spark, sf_dir, "orders").join(objects, "o_orderkey").select(
        k.cast("string").alias("query_id"), F.when(c % 17 == 0, "dev").when(c % 3 == 0, "test").otherwise("train").alias("split"), F.concat(F.lit("img/"), k.cast("string")).alias("image_path"),
        F.when(k % 31 == 0, "other").otherwise(F.get("objects", 0)["slug"]).alias("expected_slug"), F.sha2(F.concat(F.lit("p"), k.cast("string")), 256).alias("source_sha256"), F.when(k % 2 == 0, "shelf").otherwise("single").alias("scene"),
        F.lit(50).alias("width"), F.lit(12).alias("height"), "objects", F.when(k % 13 != 3, F.sha2(F.concat(F.lit("i"), k.cast("string")), 256)).alias("image_sha256"), (k % 4).alias("generator"),
        F.when(c % 5 != 0, F.concat(F.lit("f"), c.cast("string"))).alias("leakage_group"),
    )


@query(
    f"""WITH {SCENES}, d AS (SELECT *, list_transform(objects, lambda b: (b.x - 25) * (b.x - 25) + (b.y - 6) * (b.y - 6)) AS far FROM lab)
SELECT code, count(*) AS n, min(id) AS first FROM (
  SELECT id, 'invalid_split' AS code FROM d WHERE split = 'dev' UNION ALL SELECT id, 'invalid_centre_label' FROM d WHERE scene = 'shelf' AND NOT labelled
  UNION ALL SELECT id, 'invalid_distractors' FROM d WHERE scene = 'shelf' AND labelled AND (len(objects) <> 3 OR len(list_distinct(list_transform(objects, lambda b: b.slug))) <> 3)
  UNION ALL SELECT id, 'invalid_bounds' FROM d WHERE scene = 'shelf' AND labelled AND len(list_filter(objects, lambda b: b.x - 5 < 0 OR b.y - 5 < 0 OR b.x + 5 > 50 OR b.y + 5 > 12)) > 0
  UNION ALL SELECT id, 'target_not_central' FROM d WHERE scene = 'shelf' AND labelled AND len(list_filter(far[2:], lambda f: f <= far[1])) > 0
  UNION ALL SELECT id, 'missing_or_unsafe_image' FROM d WHERE k = 5 UNION ALL SELECT id, 'image_checksum_mismatch' FROM d WHERE k = 7 UNION ALL SELECT id, 'missing_image_checksum' FROM d WHERE k = 3 AND id % 4 = 3) GROUP BY code"""
)
def scene_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = _scenes(spark, sf_dir)
    k = F.col("o_orderkey")
    contents = read(spark, sf_dir, "orders").where(k % 13 != 5).select(F.concat(F.lit("img/"), k.cast("string")).alias("image_path"), F.sha2(F.concat(F.when(k % 13 == 7, "x").otherwise("i"), k.cast("string")), 256).alias("sha256"))
    return evaluate.dataset_issues(scenes, contents).groupBy("code").agg(F.count("*").alias("n"), F.min(F.col("query_id").cast("bigint")).alias("first"))


@query(
    f"""WITH {SCENES}, keys AS (SELECT split, 'class' AS kind, expected AS key FROM lab UNION ALL SELECT split, 'source', src FROM lab UNION ALL SELECT split, 'family', family FROM lab WHERE family IS NOT NULL
  UNION ALL SELECT split, 'class', unnest(list_transform(objects, lambda b: b.slug)) FROM lab UNION ALL SELECT split, 'source', unnest(list_transform(objects, lambda b: b.src)) FROM lab)
SELECT kind, key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM keys GROUP BY kind, key HAVING count(DISTINCT split) > 1"""
)
def scene_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.crossing(_scenes(spark, sf_dir)).withColumn("splits", F.array_join("splits", ","))


JSON = """b AS (SELECT event_id AS id, event_type AS t, CASE event_id % 9 WHEN 0 THEN '{"slug": " ' || event_type || ' ", "top_5": ["x", {"slug": "y "}, 3, "x"]}' WHEN 1 THEN '["a ", {"slug": "' || event_type || '"}, 7, null, {"slug": 5}]'
  WHEN 2 THEN '{"error": {"code": "busy"}}' WHEN 3 THEN '{"predicted_slug": "' || event_type || '", "wine": {"slug": "z"}}' WHEN 4 THEN '{"slug": 5, "candidates": "p| q,p"}' WHEN 5 THEN '{"slug": "' || event_type || '"}' WHEN 6 THEN '[1' WHEN 7 THEN '"text"' ELSE '[]' END AS body FROM events)"""


@query(
    f"""WITH {JSON} SELECT id, CASE id % 9 WHEN 0 THEN t WHEN 1 THEN 'a' WHEN 5 THEN t END AS slug, CASE id % 9 WHEN 0 THEN 'x,y' WHEN 1 THEN 'a,' || t WHEN 4 THEN 'p,q' WHEN 5 THEN t WHEN 8 THEN '' END AS candidates,
  CASE id % 9 WHEN 2 THEN 'busy' WHEN 6 THEN 'invalid_response' WHEN 7 THEN 'invalid_response' END AS error FROM b"""
)
def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("event_type"), _id() % 9
    bodies = [
        F.concat(F.lit('{"slug": " '), t, F.lit(' ", "top_5": ["x", {"slug": "y "}, 3, "x"]}')), F.concat(F.lit('["a ", {"slug": "'), t, F.lit('"}, 7, null, {"slug": 5}]')), F.lit('{"error": {"code": "busy"}}'),
        F.concat(F.lit('{"predicted_slug": "'), t, F.lit('", "wine": {"slug": "z"}}')), F.lit('{"slug": 5, "candidates": "p| q,p"}'), F.concat(F.lit('{"slug": "'), t, F.lit('"}')), F.lit("[1"), F.lit('"text"'), F.lit("[]"),
    ]
    body = F.element_at(F.array(*bodies), (k + 1).cast("int"))
    return read(spark, sf_dir, "events").select(_id().alias("id"), evaluate.parsed_response(body).alias("r")).select("id", "r.slug", F.array_join("r.candidates", ",").alias("candidates"), "r.error")


@query(
    """SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'a,' || event_type WHEN 1 THEN CASE WHEN event_type = 'view' THEN 'view' ELSE 'view,' || event_type END WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE '{"slug":"' || event_type || '"}' END AS names FROM events"""
)
def candidate_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    values = [F.concat(F.lit(' [1, "a ", {"slug": 5}, {"slug": "'), t, F.lit('"}, "a"]')), F.concat(F.lit("view| "), t, F.lit(", view|")), F.lit("  "), F.lit(None).cast("string"), F.lit("[broken"), F.concat(F.lit('{"slug":"'), t, F.lit('"}'))]
    return read(spark, sf_dir, "events").select(_id().alias("id"), F.array_join(T.candidate_list(F.element_at(F.array(*values), (_id() % 6 + 1).cast("int"))), ",").alias("names"))
