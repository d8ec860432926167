"""The older reading of labels: its own tokens, its own weights, evidence of producer and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quercus.functions import text as T
from quercus.functions.unicode import nfkc_casefold
from quercus.operators import textindex

# Roman numbers that labels have; numbers kept though short; words that don't tell labels or producers apart.
ROMAN = {"xviii": "18", "xxiv": "24", "xxxvi": "36", "xlv": "45"}
SHORT_NUMBERS = ["18", "24", "36", "45"]
COMMON = ["red", "rose", "vino", "white", "wine", "белое", "вино", "красное", "ред", "розовое"]
GENERIC_PRODUCERS = ["estate", "vino", "wine", "winery", "вино", "винодельня", "завод", "поместье"]
WEIGHTS = {"name": 2.0, "winery": 1.5, "other": 1.0}
FUZZY = 0.6


def tokens(c: Column) -> Column:
    """Runs of letters and digits together, three signs or more (numbers four, or 18, 24, 36, 45), in both scripts."""
    raw = F.regexp_extract_all(nfkc_casefold(F.coalesce(c, F.lit(""))), F.lit("([a-zа-яё0-9]+)"))
    number = lambda t: t.rlike("^[0-9]+$")
    kept = F.filter(raw, lambda t: (F.length(t) >= 3) & (~number(t) | (F.length(t) >= 4) | t.isin(SHORT_NUMBERS)))
    known = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    more = F.filter(F.transform(kept, lambda t: F.try_element_at(known, t)), lambda t: t.isNotNull())
    both = F.concat(kept, more)
    every = F.array_distinct(F.concat(both, F.transform(both, lambda t: T.spelled(t, T.LATIN_B))))
    return F.array_sort(F.filter(every, lambda t: (t != "") & ~t.isin(COMMON)))


def years(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("((?:19|20)[0-9]{2})")))


def index(catalogue: DataFrame, aliases: DataFrame) -> DataFrame:
    """slug, weights (map of tokens), winery_tokens, alias_tokens, canonical_tokens, own_years from slug, name, winery, grapes, photo_name and aliases (slug, alias)."""
    named = aliases.groupBy("slug").agg(F.concat_ws(" ", F.collect_list("alias")).alias("aliases"))
    rows = catalogue.join(named, "slug", "left")
    name, winery, alias = tokens(F.col("name")), tokens(F.col("winery")), tokens(F.col("aliases"))
    other = tokens(F.concat_ws(" ", "grapes", "slug", "photo_name"))
    told = rows.select("slug", name.alias("n"), winery.alias("winery_tokens"), alias.alias("alias_tokens"), other.alias("o"), years(F.concat_ws(" ", "name", "slug", "photo_name")).alias("own_years"))
    every = F.array_union(F.array_union("n", "alias_tokens"), F.array_union("winery_tokens", "o"))
    weight = lambda t: F.when(F.array_contains(F.array_union("n", "alias_tokens"), t), WEIGHTS["name"]).when(F.array_contains("winery_tokens", t), WEIGHTS["winery"]).otherwise(WEIGHTS["other"])
    pairs = F.transform(every, lambda t: F.struct(t.alias("token"), weight(t).alias("weight")))
    return told.select("slug", pairs.alias("tokens"), "winery_tokens", "alias_tokens", F.array_union(F.array_union("n", "winery_tokens"), "o").alias("canonical_tokens"), "own_years")


def ranked(queries: DataFrame, entries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, slug, score, rank, margin, matched, producer_conflict, vintage_conflict, by_alias: the k best entries for each query's text.

    Each token counts with the field that weighs most; one that no entry has counts 0.6 as its nearest known token.
    """
    posts = entries.select("slug", F.explode("tokens").alias("t")).select("slug", "t.token", "t.weight")
    total = entries.count()
    weights = textindex.idf(posts, total, "slug")
    producers = textindex.identifying(textindex.idf(entries.select("slug", F.explode("winery_tokens").alias("token")), total, "slug"), total, GENERIC_PRODUCERS).select("token")
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token"))
    unknown = asked.join(weights, "token", "left_anti")
    near = textindex.nearest_token(unknown, weights).select("token", "found")
    exact = asked.join(weights.select("token"), "token", "left_semi").select("query_id", F.col("token").alias("word"), "token", F.lit(1.0).alias("w"), F.col("token").alias("label"))
    used = exact.unionByName(unknown.join(near, "token").select("query_id", F.col("token").alias("word"), F.col("found").alias("token"), F.lit(FUZZY).alias("w"), F.col("found").alias("label")))
    valued = posts.join(weights, "token").select("slug", "token", (F.col("weight") * F.col("idf")).alias("value"))
    found = textindex.best_entries(used, valued, "slug", k + 1, 4, lambda c: F.bround(c, 4))  # one more, for the margin of the last
    score = found.select("query_id", "slug", F.bround("score", 4).alias("score"), F.array_sort(F.array_distinct("matched")).alias("matched"))
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("slug"))
    best = score.withColumns({"rank": F.row_number().over(over), "__next": F.lead("score").over(over)}).where(F.col("rank") <= k)
    said = asked.groupBy("query_id").agg(F.collect_set("token").alias("asked"))
    evidence = asked.join(producers, "token", "left_semi").select("query_id").distinct().withColumn("names_producer", F.lit(True))
    full = best.join(said, "query_id").join(evidence, "query_id", "left").join(entries.drop("tokens"), "slug")
    read = F.array_distinct(F.flatten(F.transform("asked", years)))
    return full.select(
        "query_id", "slug", "score", "rank", F.bround(F.greatest(F.lit(0.0), F.col("score") - F.coalesce("__next", F.lit(0.0))), 4).alias("margin"), "matched",
        (F.coalesce("names_producer", F.lit(False)) & ~F.arrays_overlap("asked", "winery_tokens")).alias("producer_conflict"),
        ((F.size(read) > 0) & (F.size("own_years") > 0) & ~F.arrays_overlap(read, "own_years")).alias("vintage_conflict"),
        (F.size(F.array_except(F.array_intersect("asked", "alias_tokens"), F.col("canonical_tokens"))) > 0).alias("by_alias"),
    )
