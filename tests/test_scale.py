"""What only larger tables show."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quercus.operators import graph, textindex, validate, vectors


def test_queries_count_once_where_lists_tie(spark):
    q = spark.range(3).select(F.col("id").alias("pos"), F.concat(F.lit("q"), "id").alias("query_id"), F.lit("p").alias("image_path"))
    predictions = q.select("*", F.lit("0" * 64).alias("image_sha256"), F.lit("a").alias("predicted_slug"), F.lit(1.0).alias("latency_ms"))
    lists = spark.createDataFrame([(1, "q1", None), (1, "q1", "a")], "pos bigint, query_id string, candidates string")
    totals = validate.validate(q, predictions, "pos", candidates=lists).totals
    assert totals["query_count"] == 3 and totals["missing_predictions"] == 0


def test_best_entries_equal_ranked_scores(spark, monkeypatch):
    monkeypatch.setattr(textindex, "ITEM_BLOCK", 3)
    rng = random.Random(3)
    some = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    wines = spark.createDataFrame([(i, " ".join(rng.sample(some, rng.randint(1, 3))), rng.choice(some)) for i in range(90)], "slug bigint, name string, winery string").repartition(3)
    words = spark.createDataFrame([(q, w, 0.5 + q % 2) for q in range(8) for w in rng.sample([*some, "alphabeta", "gamna", "qqqq"], 3)], "query_id bigint, text string, weight double")
    index = textindex.vocabulary(wines, {"name": 2.0, "winery": 1.5}, "slug")
    weights = textindex.idf(index, 90, "slug")
    norm = textindex.norms(index, weights, "slug")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "slug"))
    told = lambda df: sorted((r.query_id, r.slug, round(r.score, 9), round(r.coverage, 9), tuple(r.matched)) for r in df.collect())
    want = told(textindex.scored(words, index, weights, norm, "slug").withColumn("n", first).where("n <= 4").drop("n"))
    assert told(textindex.scored(words, index, weights, norm, "slug", 4)) == want and len(want) == 32
    assert told(textindex.scored(words.limit(0), index, weights, norm, "slug", 4)) == []


@pytest.mark.parametrize("k", [3, 40])
def test_usable_scores_equal_all_scores(spark, monkeypatch, k):
    monkeypatch.setattr(vectors, "ITEM_SLICE", 4)
    rng = np.random.default_rng(2)
    e = spark.createDataFrame([(i, (np.round(rng.normal(size=3)) / 4).tolist()) for i in range(30)], "id bigint, embedding array<float>").repartition(3)
    usable, q = F.col("id") % 4 != 0, e.where("id % 10 = 0")
    every = vectors.scores(q, e, None, "id", "id").where("query_id != item_id").withColumn("usable", F.col("item_id") % 4 != 0)
    best = lambda df: sorted(tuple(r) for r in vectors.ranked(vectors.view_scores(df.withColumnRenamed("item_id", "slug").withColumn("pair", F.lit(0))), k, score="v_max", tie="slug").collect())
    assert best(vectors.usable_scores(q, e, k, usable, "id", "id")) == best(every)


def test_copies_are_one_class(spark):
    rows = [(f"s{i}", "b", ["gold", "oak", "cask"]) for i in range(20)] + [("t", "b", ["gold", "oak", "cask", "old"]), ("u", "b", ["old", "none"])] + [(f"v{i}", "c", ["gold", "oak", f"own{i}"]) for i in range(20)]
    members, links = graph._similar_classes(spark.createDataFrame(rows, "slug string, block string, tokens array<string>"), "tokens", 0.65, 2)
    assert sorted(tuple(r) for r in links.collect()) == [("s0", "s0", 20, 20), ("s0", "t", 20, 1)]
    assert members.count() == 42 and members.select("class").distinct().count() == 4
