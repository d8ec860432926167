"""The answers of the search service, for batches: photo queries, analogues, pairings and cards.

Vectors, words and local matches come in as columns; models that make them run before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quercus.functions import text as T
from quercus.operators import rank, recommend

# What an error code means to a caller.
STATUS_CODES = {"empty_image": 422, "invalid_image": 422, "image_too_small": 422, "image_too_large": 413, "payload_too_large": 413, "not_found": 404, "bad_request": 400, "model_unavailable": 503}
LIMITS = (1, 12)


def clamped(limit: Column) -> Column:
    return F.least(F.greatest(limit, F.lit(LIMITS[0])), F.lit(LIMITS[1]))


def error(code: Column) -> Column:
    """status and error struct of a code."""
    known = F.create_map(*[F.lit(x) for pair in STATUS_CODES.items() for x in pair])
    return F.struct(F.coalesce(F.try_element_at(known, code), F.lit(400)).alias("status"), F.struct(code.alias("code")).alias("error"))


def search(candidates: DataFrame, weights: dict[str, float], open_set: dict[str, float], found_at: float, unknown_at: float = 0.5, not_found_at: float | None = None) -> DataFrame:
    """query_id, status, slug, confidence, confidence_top5, margin, in_catalogue, top5 from candidates with their features (and quality of the photo).

    One shuffle by query: all windows share its partitioning.
    """
    p = rank.softmax(candidates, rank.logit(weights, candidates.columns))
    placed = p.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("p"), F.asc("slug")))).where("place <= 5")
    used = [c for c in ("sift_inliers", "v_max", "t_coverage") if c in candidates.columns]
    one = placed.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "slug", F.bround("p", 4).alias("probability")))).alias("top5"),
        F.max(F.when(F.col("place") == 1, F.struct("slug", "p", *used))).alias("first"),
        F.max(F.when(F.col("place") == 2, F.col("p"))).alias("second"),
        F.least(F.lit(1.0), F.sum("p")).alias("sum5"),
        F.max("quality").alias("quality"),
    )
    known = rank.in_catalogue(F.col("first.p"), {c: F.col(f"first.{c}") for c in used}, open_set)
    return one.select(
        "query_id",
        rank.decision(F.col("first.p"), F.coalesce("quality", F.lit(1.0)), known, found_at, unknown_at=unknown_at, not_found_at=not_found_at).alias("status"),
        F.col("first.slug").alias("slug"),
        F.bround("first.p", 4).alias("confidence"),
        F.bround("sum5", 4).alias("confidence_top5"),
        F.bround(F.col("first.p") - F.coalesce("second", F.lit(0.0)), 4).alias("margin"),
        F.bround(known, 4).alias("in_catalogue"),
        "top5",
    )


def with_styles(catalogue: DataFrame) -> DataFrame:
    """catalogue (slug, name, category, winery, grapes, region) with colour, sweetness, grape_set and style."""
    told = F.concat_ws(" ", "name", "category", F.replace("slug", F.lit("-"), F.lit(" ")))
    found = catalogue.withColumn("__s", T.styles(told)).withColumns({"colour": F.try_element_at("__s", F.lit("colour")), "sweetness": F.try_element_at("__s", F.lit("sweetness")), "grape_set": T.grapes(F.col("grapes"))})
    lower = F.lower(F.concat_ws(" ", "name", "category", "slug"))
    return found.withColumn("style", recommend.style_key(lower, F.col("category"), F.col("sweetness"), F.col("colour"))).drop("__s")


def analogues(catalogue: DataFrame, slugs: DataFrame, k: int = 4, other_makers: bool = True, visual: DataFrame | None = None) -> DataFrame:
    """query, item, score, reasons, rank: what is most like each of slugs (column slug). A category counts only for pairs of no common colour. visual: query, item, similarity of their pictures."""
    wines = with_styles(catalogue)
    asked = wines.join(slugs.select("slug").distinct(), "slug", "left_semi")
    rules = [("same colour", F.col("colour"), 3.0), ("same category", F.nullif("category", F.lit("")), 2.0, "same colour"), ("same sweetness", F.col("sweetness"), 2.0), ("shared grapes", F.col("grape_set"), 3.0), ("same region", F.nullif("region", F.lit("")), 1.0)]
    return recommend.analogues(wines, asked, "slug", rules, "winery" if other_makers else None, k, visual)


def pairings(catalogue: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (slug, dish, sauce, preference) with dish_key, style, score, verdict, serving and rules_version."""
    wines = with_styles(catalogue)
    rows = requests.join(wines, "slug").withColumn("dish_key", recommend.dish(F.col("dish"), F.col("sauce")))
    score = recommend.pairing_score(F.col("dish_key"), F.col("style"))
    fits = recommend.taste_fits(F.col("sweetness"), F.col("preference"))
    return rows.select("slug", "dish", "preference", "dish_key", "style", score.alias("score"), recommend.verdict(score, fits).alias("verdict"), recommend.serving(F.col("style")).alias("serving"), F.lit(recommend.RULES_VERSION).alias("rules_version"))


def cards(catalogue: DataFrame) -> DataFrame:
    """What a card shows: title (of the slug if there is no name), grapes in a line, image address."""
    title = F.coalesce(T.first_filled(F.col("name")), F.initcap(F.replace("slug", F.lit("-"), F.lit(" "))))
    image = F.when(F.coalesce("photo_name", F.lit("")) != "", F.concat(F.lit("/v1/wines/"), "slug", F.lit("/image")))
    return catalogue.select("slug", title.alias("title"), F.array_join(T.grapes(F.col("grapes")), ", ").alias("grapes"), image.alias("image_url"))


def ready(catalogue: DataFrame, index: DataFrame, version: str) -> DataFrame:
    """status, catalog_count, indexed_count, model_version: one row; not_ready without a catalogue."""
    n = catalogue.agg(F.count_distinct("slug").alias("catalog_count"))
    return n.crossJoin(index.agg(F.count_distinct("slug").alias("indexed_count"))).select(F.when(F.col("catalog_count") > 0, "ready").otherwise("not_ready").alias("status"), "catalog_count", "indexed_count", F.lit(version).alias("model_version"))  # one row each


def predictions(answers: DataFrame) -> DataFrame:
    """What the evaluation's route gives of search(): the best slug alone."""
    return answers.select("query_id", "slug")


def looked_up(catalogue: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (slug) with status, code and the card of each; slugs that the catalogue lacks are 404 wine_not_found."""
    known = cards(catalogue).withColumn("__k", F.lit(True))
    found = asked.join(known, "slug", "left")
    return found.select("slug", F.when(F.col("__k"), 200).otherwise(404).alias("status"), F.when(F.col("__k").isNull(), "wine_not_found").alias("code"), "title", "grapes", "image_url")


def pictures(catalogue: DataFrame, files: DataFrame, asked: DataFrame, scenes: list[str] | None = None) -> DataFrame:
    """asked (slug) with status, code and the file (files: name) of its picture; names that lead elsewhere, absent files and pictures of whole scenes are 404 image_not_found."""
    named = catalogue.select("slug", F.col("photo_name").alias("name")).where(F.coalesce("name", F.lit("")) != "").where(~F.col("name").contains("/") & T.safe_path(F.col("name")))
    if scenes:
        named = named.where(~F.col("slug").isin(scenes))
    found = asked.join(named.join(files.select("name").distinct(), "name"), "slug", "left")
    return found.select("slug", F.when(F.col("name").isNotNull(), 200).otherwise(404).alias("status"), F.when(F.col("name").isNull(), "image_not_found").alias("code"), F.col("name").alias("file"))


def searched(answers: DataFrame, catalogue: DataFrame, k: int = 4) -> DataFrame:
    """answers of search() with analogs: what is like the best wine of each answer that isn't found, makers alike or not (item and reasons, best first)."""
    lost = answers.where("status != 'found'").select("query_id", "slug")
    like = analogues(catalogue, lost.select("slug"), k, other_makers=False).groupBy(F.col("query").alias("slug")).agg(F.array_sort(F.collect_list(F.struct("rank", "item", "reasons"))).alias("analogs"))  # k of each
    return answers.join(lost.join(like, "slug").select("query_id", "analogs"), "query_id", "left")
