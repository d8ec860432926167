"""Retrieval over embeddings: queries are the vectors whose id is divisible by 50, the gallery is all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus.functions.tables import read, written
from quercus.operators import evaluate, fit, rank, vectors
from quercus.plans.registry import query

EVERY = 50
SCORES = f"""
scores AS (
  SELECT q.vec_id AS query_id, q.label AS expected, g.vec_id AS item_id, g.label AS item_label,
         round(list_inner_product(q.embedding::DOUBLE[], g.embedding::DOUBLE[]), 6) + 0.0::DOUBLE AS score
  FROM embeddings q JOIN embeddings g ON q.vec_id % {EVERY} = 0 AND q.vec_id <> g.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scores)"""
SOFTMAX = f"""{SCORES},
z AS (SELECT *, exp(25.0::DOUBLE * score - max(25.0::DOUBLE * score) OVER (PARTITION BY query_id)) AS e FROM ranked WHERE rank <= 30),
probability AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS p FROM z),
best AS (
  SELECT query_id, max(CASE WHEN rank = 1 THEN item_id END) AS best, max(CASE WHEN rank = 1 THEN p END) AS p1,
         max(CASE WHEN rank = 1 THEN p END) - coalesce(max(CASE WHEN rank = 2 THEN p END), 0) AS margin,
         least(1.0::DOUBLE, sum(p) FILTER (rank <= 5)) AS confidence_top5, max(score) AS v_max
  FROM probability GROUP BY query_id)"""
POOLED = f"""{SCORES},
pooled AS (SELECT query_id, expected, item_label AS label, max(score) AS score FROM scores GROUP BY ALL),
places AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM pooled)"""


def _queries(e: DataFrame) -> DataFrame:
    return e.where(F.col("vec_id") % EVERY == 0)


def _top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return vectors.top_k(_queries(e), e, k, "vec_id", "vec_id")


def _labelled(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    top = _top(spark, sf_dir, k)
    names = e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("item_label"))
    truth = _queries(e).select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected"))
    return top.join(names, "item_id").join(truth, "query_id")


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    found = vectors.label_scores(_queries(e), e, "vec_id", "label", item_id="vec_id")
    return vectors.ranked(found, tie="label")


@query(f"WITH {SCORES} SELECT query_id, item_id, score, rank FROM ranked WHERE rank <= 5")
def exact_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 5)


@query(f"WITH {POOLED} SELECT query_id, label, score, rank FROM places WHERE rank <= 5")
def label_maxpool_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir).where("rank <= 5")


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.softmax(_labelled(spark, sf_dir, 30), 25.0 * F.col("score"))


def _margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.margins(_probabilities(spark, sf_dir), tie="item_id")


@query(f"WITH {SOFTMAX} SELECT query_id, best, round(p1, 5) AS p1, round(margin, 5) AS margin, round(confidence_top5, 5) AS confidence_top5 FROM best")
def group_softmax_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _margins(spark, sf_dir).select("query_id", "best", *(F.round(c, 5).alias(c) for c in ("p1", "margin", "confidence_top5")))


DECIDED = "1 / (1 + exp(-(-6.0::DOUBLE + 4.0::DOUBLE * p1 + 9.0::DOUBLE * v_max)))"


@query(
    f"""WITH {SOFTMAX}, known AS (SELECT *, {DECIDED} AS known FROM best)
SELECT query_id, round(known, 5) AS known,
       CASE WHEN known < 0.5 THEN 'not_found' WHEN p1 >= 0.2 THEN 'found' WHEN margin < 0.005 THEN 'low_quality' ELSE 'uncertain' END AS status FROM known"""
)
def decision_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _probabilities(spark, sf_dir)
    best = rank.margins(p, tie="item_id").join(p.groupBy("query_id").agg(F.max("score").alias("v_max")), "query_id")
    known = rank.in_catalogue(F.col("p1"), {"v_max": F.col("v_max")}, {"bias": -6.0, "p1": 4.0, "v_max": 9.0})
    return best.withColumn("known", known).select("query_id", F.round("known", 5).alias("known"), rank.decision(F.col("p1"), F.col("margin"), F.col("known"), 0.2, 0.005).alias("status"))


@query(
    f"""WITH {SCORES}, t AS (SELECT query_id, max(score) FILTER (item_label = expected) AS best FROM ranked WHERE rank <= 50 GROUP BY query_id),
r AS (SELECT t.query_id, CASE WHEN any_value(best) IS NOT NULL THEN 1 + count(*) FILTER (score > best) END AS rank FROM ranked r JOIN t USING (query_id) WHERE r.rank <= 50 GROUP BY t.query_id)
SELECT count(*) AS n, avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS acc_1, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS recall_5,
       avg(CASE WHEN rank <= 20 THEN 1.0::DOUBLE ELSE 0 END) AS recall_20, avg(CASE WHEN rank <= 50 THEN 1.0::DOUBLE ELSE 0 END) AS recall_50 FROM r"""
)
def rank_of_truth_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.truth_rank(_labelled(spark, sf_dir, 50), F.col("item_label") == F.col("expected"))
    share = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return found.agg(F.count("*").alias("n"), share(1).alias("acc_1"), share(5).alias("recall_5"), share(20).alias("recall_20"), share(50).alias("recall_50"))


PREDICTED = f"{SCORES}, rows AS (SELECT query_id, expected, item_label AS predicted, score FROM ranked WHERE rank = 1)"
PER_CLASS = """e AS (SELECT expected AS class, count(*) AS support, sum((expected = predicted)::INT)::BIGINT AS tp FROM rows GROUP BY 1),
p AS (SELECT predicted AS class, count(*) AS predicted_n FROM rows GROUP BY 1),
c AS (SELECT coalesce(e.class, p.class) AS class, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted_n, 0) AS predicted_n FROM e FULL JOIN p ON e.class = p.class),
f AS (SELECT *, CASE WHEN predicted_n = 0 THEN 0 ELSE tp::DOUBLE / predicted_n END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS recall,
             CASE WHEN support + predicted_n = 0 THEN 0 ELSE 2 * tp::DOUBLE / (support + predicted_n) END AS f1 FROM c)"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir, 1).select("query_id", "expected", F.col("item_label").alias("predicted"), "score")


@query(f"WITH {PREDICTED}, {PER_CLASS} SELECT class, support, predicted_n, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_class(_predictions(spark, sf_dir)).select("class", "support", "predicted_n", "tp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(
    f"""WITH {POOLED}, rows AS (SELECT query_id, expected, label AS predicted FROM places WHERE rank = 1), {PER_CLASS},
cand AS (SELECT query_id, any_value(expected) AS expected, coalesce(min(rank) FILTER (label = expected), 0) AS place FROM places WHERE rank <= 5 GROUP BY query_id)
SELECT (SELECT count(*) FROM rows) AS n, (SELECT round(avg((expected = predicted)::INT::DOUBLE), 6) FROM rows) AS accuracy, (SELECT round(avg(f1), 6) FROM f) AS macro_f1,
       (SELECT round(avg((place > 0)::INT::DOUBLE), 6) FROM cand) AS recall_at_k, (SELECT round(avg(CASE WHEN place > 0 THEN 1.0::DOUBLE / place ELSE 0 END), 6) FROM cand) AS mrr_at_k"""
)
def macro_f1_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    truth = _queries(e).select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected"))
    top = _pooled(spark, sf_dir).where("rank <= 5").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("candidates"))
    rows = truth.join(top, "query_id").withColumn("predicted", F.get("candidates", 0))
    both = evaluate.summary(rows).crossJoin(evaluate.candidate_metrics(rows))
    return both.select("n", *(F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "recall_at_k", "mrr_at_k")))


@query(
    f"""WITH {PREDICTED}, n AS (SELECT *, row_number() OVER (ORDER BY score DESC, query_id) AS place, count(*) OVER () AS total FROM rows)
SELECT CASE WHEN place <= floor(total / 2) THEN 'top' ELSE 'bottom' END AS half, count(*) AS n, round(avg((expected = predicted)::INT::DOUBLE), 6) AS accuracy FROM n GROUP BY 1"""
)
def confidence_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir).withColumn("correct", F.col("expected") == F.col("predicted"))
    return evaluate.confidence_halves(rows, "score", "query_id").withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {PREDICTED} SELECT expected, predicted, count(*) AS n FROM rows WHERE expected <> predicted GROUP BY ALL ORDER BY n DESC, expected, predicted LIMIT 8")
def confusion_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusions(_predictions(spark, sf_dir))


@query(
    f"""WITH {SCORES}, t AS (SELECT *, CASE WHEN item_label = expected THEN (item_id % 7 + 1)::DOUBLE END AS text_score FROM ranked WHERE rank <= 60),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC NULLS LAST, item_id) AS place FROM t)
SELECT query_id, item_id, score, text_score FROM o WHERE rank <= 30 OR (text_score IS NOT NULL AND place <= 10)"""
)
def shortlist_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _labelled(spark, sf_dir, 60).withColumn("text_score", F.when(F.col("item_label") == F.col("expected"), (F.col("item_id") % 7 + 1).cast("double")))
    return rank.shortlist(found, "score", "text_score", "item_id").select("query_id", "item_id", "score", "text_score")


@query(f"WITH {SCORES} SELECT query_id, item_id, round(score - max(score) OVER (PARTITION BY query_id), 6) + 0.0::DOUBLE AS v_gap, round(-ln(rank::DOUBLE), 6) + 0.0::DOUBLE AS v_rank FROM ranked WHERE rank <= 30")
def rank_gap_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank.visual_features(_top(spark, sf_dir, 30), "score", "item_id")
    return found.select("query_id", "item_id", (F.round("v_gap", 6) + 0.0).alias("v_gap"), (F.round("v_rank", 6) + 0.0).alias("v_rank"))


@query(f"WITH {SOFTMAX}, t AS (SELECT query_id, max(p) AS p1 FROM probability GROUP BY query_id) SELECT round(quantile_cont(p1, 0.03), 5) AS threshold, count(*) AS n FROM t")
def open_set_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.open_set_threshold(_probabilities(spark, sf_dir)).select(F.round("threshold", 5).alias("threshold"), "n")


@query(
    f"""WITH {SCORES}, s AS (SELECT *, item_label::DOUBLE AS other FROM ranked WHERE rank <= 30),
z AS (SELECT *, avg(score) OVER w AS ms, stddev_pop(score) OVER w AS ds, avg(other) OVER w AS mo, stddev_pop(other) OVER w AS d_o FROM s WINDOW w AS (PARTITION BY query_id))
SELECT query_id, item_id, round(0.7::DOUBLE * coalesce((score - ms) / nullif(ds, 0), 0) + 0.3::DOUBLE * coalesce((other - mo) / nullif(d_o, 0), 0), 4) + 0.0::DOUBLE AS blend FROM z"""
)
def zscore_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _labelled(spark, sf_dir, 30).withColumn("other", F.col("item_label").cast("double"))
    return vectors.blended(found, {"score": 0.7, "other": 0.3}).select("query_id", "item_id", (F.round("blend", 4) + 0.0).alias("blend"))


@query(
    f"""WITH {SOFTMAX}, t AS (SELECT p.*, b.p1 FROM probability p JOIN best b USING (query_id) WHERE item_id <> b.best)
SELECT query_id, item_id, round(p / sum(p) OVER (PARTITION BY query_id), 5) AS p FROM t"""
)
def softmax_without_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _probabilities(spark, sf_dir).withColumn("label", (F.col("rank") == 1).cast("int"))
    return fit.without_truth(p).select("query_id", "item_id", F.round("p", 5).alias("p"))


@query()
def fusion_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank.visual_features(_labelled(spark, sf_dir, 30), "score", "item_id")
    first = F.min(F.when(F.col("item_label") == F.col("expected"), F.col("rank"))).over(vectors.Window.partitionBy("query_id"))
    rows = written(found.withColumn("label", (F.col("rank") == first).cast("int")).na.fill(0, ["label"]).select("query_id", "item_id", "label", "score", "v_gap", "v_rank"), "features")
    weights = fit.conditional_logit(rows, ["score", "v_rank"])
    return spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "feature string, weight double")
