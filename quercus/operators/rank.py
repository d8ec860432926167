"""From evidence to ranked answers: shortlist, features, probabilities, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VISUAL_SHORTLIST, TEXT_SHORTLIST = 30, 10


def _over(by: str):
    return Window.partitionBy(by)


def shortlist(found: DataFrame, visual: str, text: str, tie: str, n_visual: int = VISUAL_SHORTLIST, n_text: int = TEXT_SHORTLIST, by: str = "query_id") -> DataFrame:
    """The n_visual best by one score and the n_text best by another (null: no such evidence), once each."""
    v = F.row_number().over(_over(by).orderBy(F.col(visual).desc_nulls_last(), F.col(tie)))
    t = F.row_number().over(_over(by).orderBy(F.col(text).desc_nulls_last(), F.col(tie)))
    return found.withColumn("__v", v).withColumn("__t", t).where((F.col("__v") <= n_visual) | (F.col(text).isNotNull() & (F.col("__t") <= n_text))).drop("__v", "__t")


def visual_features(found: DataFrame, mean: str = "v_mean", tie: str = "slug", by: str = "query_id") -> DataFrame:
    """found, over the whole gallery of each query, with v_gap (to the best) and v_rank (-ln of the rank from 1)."""
    rank = F.row_number().over(_over(by).orderBy(F.desc(mean), F.asc(tie)))
    return found.withColumns({"v_gap": F.col(mean) - F.max(mean).over(_over(by)), "v_rank": -F.log1p((rank - 1).cast("double"))})


def evidence_features(candidates: DataFrame, idf: Column | None = None, by: str = "query_id") -> DataFrame:
    """candidates (shortlisted, with visual_features, inliers, matches, t_raw, best_text, matched) with the local and text features.

    idf: a map column from words to weights (1 for others). Missing evidence counts as none.
    """
    over = _over(by)
    weight = (lambda w: F.coalesce(F.try_element_at(idf, w), F.lit(1.0))) if idf is not None else (lambda w: F.lit(1.0))
    total = lambda words: F.aggregate(words, F.lit(0.0), lambda s, w: s + weight(w))
    inliers, matches = F.coalesce("inliers", F.lit(0)), F.coalesce("matches", F.lit(0))
    t_score = F.coalesce(F.log1p("t_raw"), F.lit(0.0))
    own = F.coalesce("matched", F.array().cast("array<string>"))
    explained = F.array_distinct(F.flatten(F.collect_list(own).over(over)))
    return candidates.withColumns(
        {
            "sift_inliers": F.log1p(inliers.cast("double")),
            "sift_matches": F.log1p(matches.cast("double")),
            "sift_best": ((inliers >= 8) & (inliers == F.max(inliers).over(over))).cast("double"),
            "t_score": t_score,
            "t_gap": t_score - F.log1p(F.coalesce("best_text", F.lit(0.0))),
            "t_present": F.col("t_raw").isNotNull().cast("double"),
            "__explained": explained,
        }
    ).withColumn("t_missing", F.when(F.size("__explained") > 0, total(F.array_except("__explained", own)) / total(F.col("__explained"))).otherwise(0.0)).drop("__explained")


def softmax(found: DataFrame, logit: Column, by: str = "query_id", name: str = "p") -> DataFrame:
    """found with the probability of each row among those of its query."""
    top = F.max("__z").over(_over(by))
    return found.withColumn("__z", logit).withColumn("__e", F.exp(F.col("__z") - top)).withColumn(name, F.col("__e") / F.sum("__e").over(_over(by))).drop("__z", "__e")


def logit(weights: dict[str, float], columns: list[str]) -> Column:
    return sum((F.lit(w) * F.col(c) for c, w in weights.items() if c in columns), F.lit(0.0))


def margins(found: DataFrame, p: str = "p", tie: str = "slug", by: str = "query_id") -> DataFrame:
    """One row for each query: best, p1, margin to the second, confidence of the first five (1 at most)."""
    place = F.row_number().over(_over(by).orderBy(F.desc(p), F.asc(tie)))
    marked = found.withColumn("__n", place).where("__n <= 5")
    at = lambda n, c: F.max(F.when(F.col("__n") == n, F.col(c)))
    return marked.groupBy(by).agg(at(1, tie).alias("best"), at(1, p).alias("p1"), (at(1, p) - F.coalesce(at(2, p), F.lit(0.0))).alias("margin"), F.least(F.lit(1.0), F.sum(p)).alias("confidence_top5"))


def in_catalogue(p1: Column, features: dict[str, Column], weights: dict[str, float]) -> Column:
    """Logistic probability that the thing is known at all; null without weights."""
    if not weights:
        return F.lit(None).cast("double")
    z = F.lit(weights.get("bias", 0.0)) + sum((F.lit(weights.get(k, 0.0)) * F.coalesce(v, F.lit(0.0)) for k, v in {"p1": p1, **features}.items()), F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-z))


def decision(confidence: Column, quality: Column, known: Column, found_at: float = 0.8, low_quality_at: float = 0.2, unknown_at: float = 0.5, not_found_at: float | None = None) -> Column:
    """In this order: not_found if the thing isn't known, found from found_at on, low_quality, not_found below not_found_at if nothing says whether it is known, uncertain."""
    lost = (known.isNull() & (confidence < not_found_at)) if not_found_at is not None else F.lit(False)
    return F.when(F.coalesce(known < unknown_at, F.lit(False)), "not_found").when(confidence >= found_at, "found").when(quality < low_quality_at, "low_quality").when(lost, "not_found").otherwise("uncertain")


def cascade_decision(confidence: Column, low_quality: Column, indexed: Column, found_at: float) -> Column:
    """Status of an answer that has no probabilities."""
    return F.when(~indexed, "uncertain").when(low_quality & (confidence < found_at), "low_quality").when(confidence >= found_at, "found").otherwise("uncertain")


def visual_confidence(similarity: Column, margin: Column, quality: Column) -> Column:
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return F.bround((0.75 * unit((similarity + 1) / 2) + 0.25 * unit(margin)) * (0.75 + 0.25 * quality), 4)


def text_confidence(score: Column, margin: Column, conflict: Column | None = None, by_alias: Column | None = None, indexed: Column | None = None) -> Column:
    """Grows with both, to 0.96; bounded where the words contradict, hang on an alias, hardly lead, or the thing has no picture."""
    plain = F.least(F.lit(0.96), 0.5 + 0.28 * (1 - F.exp(-score / 12)) + 0.18 * (1 - F.exp(-margin / 8)))
    if conflict is None:
        return plain
    bounded = F.when(conflict, F.least(plain, F.lit(0.55))).when(by_alias, F.least(plain, F.lit(0.69))).when(margin < 1, F.least(plain, F.lit(0.75))).otherwise(plain)
    return bounded if indexed is None else F.when(indexed, bounded).otherwise(F.least(bounded, F.lit(0.69)))


def neural_confidence(margin: Column) -> Column:
    return F.least(F.lit(0.86), F.greatest(F.lit(0.5), 0.58 + 0.8 * margin))


def strong_match(found: DataFrame, least: int = 10, apart: float = 0.30, by: str = "query_id") -> DataFrame:
    """query_id, slug, confidence of queries whose best local match (score, then slug) has least inliers and leads by apart of its score."""
    over = _over(by).orderBy(F.desc("score"), F.asc("slug"))
    led = found.withColumn("__n", F.row_number().over(over)).withColumn("__next", F.lead("score").over(over)).where("__n = 1 and __next is not null")
    lead = (F.col("score") - F.col("__next")) / F.greatest(F.col("score"), F.lit(1e-9))
    return led.withColumn("__lead", lead).where((F.col("inliers") >= least) & (F.col("__lead") >= apart)).select(by, "slug", F.least(F.lit(0.94), 0.76 + 0.18 * F.col("__lead")).alias("confidence"))


def best_reference(found: DataFrame, by: str = "query_id") -> DataFrame:
    """For each slug its reference with most inliers, then matches."""
    return found.groupBy(by, "slug").agg(F.max(F.struct("inliers", "matches")).alias("b")).select(by, "slug", "b.inliers", "b.matches")


def local_score(inliers: Column, matches: Column, votes: Column) -> Column:
    return inliers + 0.05 * matches + 0.001 * votes


def ratio_matches(neighbours: DataFrame, ratio: float = 0.78) -> DataFrame:
    """From the two nearest train points of each query point (query_id, slug, point, train, distance, nth): those that pass the ratio test, one for each train point."""
    two = neighbours.groupBy("query_id", "slug", "point").agg(
        F.min_by("train", "nth").alias("train"), F.min(F.when(F.col("nth") == 1, F.col("distance"))).alias("d1"), F.min(F.when(F.col("nth") == 2, F.col("distance"))).alias("d2")
    )
    passed = two.where(F.col("d1") < ratio * F.col("d2"))
    return passed.groupBy("query_id", "slug", "train").agg(F.min(F.struct("d1", "point")).alias("b")).select("query_id", "slug", "train", F.col("b.point").alias("point"), F.col("b.d1").alias("distance"))


def soft_votes(neighbours: DataFrame) -> DataFrame:
    """query_id, slug, votes: one for each nearest neighbour, three if it passes the ratio test."""
    return neighbours.groupBy("query_id", "slug").agg(F.sum(1 + 2 * F.col("passes").cast("int")).alias("votes"))


def cascade(queries: DataFrame, stages: list[tuple[str, DataFrame]], by: str = "query_id") -> DataFrame:
    """query_id, slug, confidence, method of the first stage (query_id, slug, confidence) that answers a query; nulls if none does."""
    out = queries.select(by).distinct()
    for name, found in stages:
        out = out.join(found.select(by, F.struct("slug", "confidence", F.lit(name).alias("method")).alias(f"__{name}")), by, "left")
    answer = F.coalesce(*(F.col(f"__{name}") for name, _ in stages))
    return out.withColumn("__a", answer).select(by, "__a.slug", "__a.confidence", "__a.method")


def once_by_payload(queries: DataFrame, payload: str = "payload_sha256", by: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """Queries with each payload once (that with the least id), and the map from all ids to those."""
    first = queries.groupBy(payload).agg(F.min(by).alias("first"))
    return queries.join(first, (queries[by] == first["first"]) & (queries[payload] == first[payload]), "left_semi"), queries.select(by, payload).join(first, payload)


def vote_shortlist(votes: DataFrame, most: int = 20, by: str = "query_id") -> DataFrame:
    """votes (query_id, slug, votes): the most entries with most votes of each query (of equal ones the first by name). Only those are verified point by point."""
    return votes.withColumn("__n", F.row_number().over(_over(by).orderBy(F.desc("votes"), F.asc("slug")))).where(F.col("__n") <= most).drop("__n")


# The score from which label words override pictures, what a margin of words counts for, and the answer's methods.
OVERRIDE, WORDS, METHODS = 7.0, 10.0, ("fusion", "local_features", "handcrafted", "dinov2", "ocr")


def legacy_cascade(queries: DataFrame, fusion: DataFrame, local: DataFrame, visual: DataFrame, neural: DataFrame, words: DataFrame, by: str = "query_id") -> DataFrame:
    """query_id, slug, confidence, margin, method: fused evidence if there is any; else a strong local match; else the words of the label if they score OVERRIDE or more; else the neural picture, but not in front of side objects; else the handcrafted one.

    queries: query_id, side_objects. fusion, local, visual: query_id, slug, confidence, margin. neural: query_id, slug,
    margin. words: query_id, slug, score, margin, conflict, by_alias, indexed. Queries that no stage answers have nulls.
    """
    of = lambda df, name, confidence, margin: df.select(by, F.struct("slug", F.bround(confidence, 4).alias("confidence"), F.bround(margin, 4).alias("margin"), F.lit(name).alias("method")).alias(f"__{name}"))
    read = text_confidence(F.col("score"), F.col("margin"), F.col("conflict"), F.col("by_alias"), F.col("indexed"))
    stages = [
        of(fusion, METHODS[0], F.col("confidence"), F.col("margin")),
        of(local, METHODS[1], F.col("confidence"), F.col("margin")),
        of(words.where(F.col("score") >= OVERRIDE), METHODS[4], read, F.least(F.lit(1.0), F.col("margin") / WORDS)),
        of(neural, METHODS[3], neural_confidence(F.col("margin")), F.least(F.lit(1.0), F.col("margin"))),
        of(visual, METHODS[2], F.col("confidence"), F.col("margin")),
    ]
    out = queries.select(by, "side_objects")
    for stage in stages:
        out = out.join(stage, by, "left")
    shelf = F.coalesce("side_objects", F.lit(False))
    answer = F.coalesce("__fusion", "__local_features", "__ocr", F.when(~shelf, F.col("__dinov2")), "__handcrafted")
    return out.withColumn("__a", answer).select(by, "__a.slug", "__a.confidence", "__a.margin", "__a.method")
