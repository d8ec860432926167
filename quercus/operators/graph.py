"""Groups, components and splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quercus.functions import text as T
from quercus.functions.hashing import short_id, weighted_choice
from quercus.functions.tables import forget, written
from quercus.operators.catalog import require_none


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of the graph with these edges (two long columns): node, root (the least node).

    Large-star and small-star rounds (Kiveris et al., 2014) until the edges are stars. Every round is written to the
    shared folder. The minima are written too, so that the join sides are plain shuffles that AQE can split at a hub.
    Self-loops and nulls are left out; repeated edges don't matter; without edges the result is empty.
    """
    big, small = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    now = written(edges.where(F.col(a) != F.col(b)).select(big, small).distinct(), "edges")
    before = None
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low2 = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        joined = large.join(low2, "a")
        after = written(
            joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b"))).distinct(),
            "edges",
        )
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in (now, low, large, low2):
            forget(old)
        now = after
        if state == before or state[0] == 0:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def components_by_keys(rows: DataFrame, row_id: str, keys: list[Column]) -> DataFrame:
    """row_id, component (its least row id): rows that share a value of any of the keys (null: none) belong together.

    Each value links its rows to the least of them: as many edges as rows and keys, whatever a value's count.
    """
    tagged = rows.select(F.col(row_id).alias("id"), F.explode(F.array(*(F.concat(F.lit(f"{n}:"), k) for n, k in enumerate(keys)))).alias("key")).where("key is not null")
    least = tagged.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    found = components(tagged.join(least, "key").select("id", "least"), "id", "least")
    return rows.select(F.col(row_id)).join(found, F.col(row_id) == found.node, "left").select(row_id, F.coalesce("root", row_id).alias("component"))


def component_splits(members: DataFrame, weights: dict[str, float], seed: str) -> DataFrame:
    """component, split, issue: the declared split if the members (component, key, split) have one only and it has a weight, else by hash of the least key."""
    known = members.groupBy("component").agg(F.collect_set(F.nullif(F.trim("split"), F.lit(""))).alias("declared"), F.min("key").alias("key"))
    names = F.array(*(F.lit(n) for n in weights))
    return known.select(
        "component",
        F.when(F.size("declared") == 0, weighted_choice(F.col("key"), seed, weights)).when((F.size("declared") == 1) & F.arrays_overlap("declared", names), F.get("declared", 0)).alias("split"),
        F.when(F.size("declared") > 1, "conflicting_splits").when((F.size("declared") == 1) & ~F.arrays_overlap("declared", names), "unknown_split").alias("issue"),
    )


def leaks(rows: DataFrame, split: str, keys: dict[str, Column]) -> DataFrame:
    """kind, key, splits of the values that occur in more than one split."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in keys.items()))
    return rows.select(F.col(split).alias("split"), F.explode(pairs).alias("p")).where("p.key is not null").groupBy("p.kind", "p.key").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def similar_pairs(rows: DataFrame, row_id: str, block: str, tokens: Column, least: float, common: int) -> DataFrame:
    """a, b, score, common: pairs in one block whose token sets have a Jaccard similarity of least and common tokens in common.

    Tokens of a set stand in the order of rarity. Two sets as similar as that share a token among the first of both, as many
    as leave too few behind them: pairs meet on those alone, so a token that many sets have brings no pairs unless it is among
    a set's rarest. Sets of too different sizes don't meet. Pairs are then counted whole.
    """
    sets = rows.select(F.col(row_id).alias("id"), F.col(block).alias("block"), F.array_sort(F.array_distinct(tokens)).alias("tokens")).where("block is not null and size(tokens) > 0")
    sets = written(sets, "sets")
    posts = sets.select("id", "block", F.explode("tokens").alias("token"))
    rarity = posts.groupBy("block", "token").agg(F.count("*").alias("df")).where("df > 1")  # a token of one set brings no pair
    ordered = posts.join(rarity, ["block", "token"]).groupBy("id", "block").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    n = F.size("tokens")
    need = F.greatest(F.ceil(F.lit(least) * n - 1e-9), F.lit(common), F.lit(1)).cast("int")  # tokens that a partner has at least
    # tokens of one set alone are the rarest: they stand first and take up places of the prefix
    places = n - need + 1 - (n - F.size("shared"))
    able = ordered.join(sets.select("id", "tokens"), "id").withColumn("places", places).where("places > 0")
    heads = written(able.select("id", "block", n.alias("n"), F.explode(F.slice("shared", F.lit(1), F.col("places"))).alias("s")).select("id", "block", "n", "s.token"), "heads")
    left, right = heads.alias("l"), heads.alias("r")
    alike = (F.col("l.block") == F.col("r.block")) & (F.col("l.token") == F.col("r.token")) & (F.col("l.id") < F.col("r.id"))
    near = (F.col("l.n") >= least * F.col("r.n") - 1e-9) & (F.col("r.n") >= least * F.col("l.n") - 1e-9)
    met = left.join(right, alike & near).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    of = lambda side: sets.select(F.col("id").alias(side), F.col("tokens").alias(f"of_{side}"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    whole = met.join(of("a"), "a").join(of("b"), "b").withColumn("common", shared.cast("bigint"))
    score = F.col("common") / (F.size("of_a") + F.size("of_b") - F.col("common"))
    return whole.withColumn("score", score).where((F.col("common") >= common) & (F.col("score") >= least)).select("a", "b", "score", "common")


def bounded_neighbours(pairs: DataFrame, most: int = 16) -> DataFrame:
    """src, dst, score, reasons, rank from pairs a, b, score, reason: both ways, reasons together, the most best of each src."""
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score", "reason").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "score", "reason"))
    one = both.groupBy("src", "dst").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), F.asc("dst"))).cast("bigint")).where(F.col("rank") <= most)


def bucket_pairs(rows: DataFrame, row_id: str, bucket: Column, weight: float, reason: str, most: int) -> DataFrame:
    """a, b, score, reason: all pairs of each bucket of 2 to most rows. Larger buckets say too little and are left out (see oversized_buckets); so a bucket's pairs are bounded."""
    tagged = rows.select(F.col(row_id).alias("id"), bucket.alias("bucket")).where("bucket is not null").distinct()
    sized = tagged.groupBy("bucket").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= most))
    kept = tagged.join(sized, "bucket")
    return kept.alias("l").join(kept.alias("r"), (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.lit(weight).alias("score"), F.lit(reason).alias("reason"))


def oversized_buckets(rows: DataFrame, row_id: str, bucket: Column, most: int) -> DataFrame:
    return rows.select(F.col(row_id).alias("id"), bucket.alias("bucket")).where("bucket is not null").distinct().groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most)


def cluster_report(items: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """One row: items, covered (in some pair), fraction (6 digits), and pairs by reason as a map."""
    covered = pairs.select(F.col("a").alias(key)).union(pairs.select(F.col("b").alias(key))).distinct()
    reasons = pairs.groupBy("reason").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("by_reason"))
    counts = items.select(key).distinct().join(covered.withColumn("__c", F.lit(1)), key, "left").agg(F.count("*").alias("items"), F.count("__c").alias("covered"))
    return counts.crossJoin(reasons).select("items", "covered", F.round(F.col("covered") / F.nullif("items", F.lit(0)), 6).alias("fraction"), "by_reason")


# Words that don't tell names apart, and what a reason for confusion weighs.
COMMON_WORDS = [
    "вино", "wine", "vino", "белое", "красное", "розовое", "сухое", "полусухое", "сладкое", "полусладкое", "брют", "beloe", "krasnoe", "rozovoe", "suhoe",
    "polusuhoe", "polusladkoe", "bryut", "г", "год", "года",
]
REASONS = {
    "same_name_without_vintage": 1.0,
    "same_slug_without_vintage": 1.0,
    "same_series_tokens": 0.9,
    "near_name_tokens": 0.8,
    "near_slug_tokens": 0.75,
    "same_grapes_category": 0.6,
}
NEAR, NEAR_COMMON = 0.65, 2


@dataclass(frozen=True)
class Confusion:
    """clusters: cluster_id, reason, winery, signature, slugs. neighbours: src, dst, score, reasons, rank. report: one row of counts."""

    clusters: DataFrame
    neighbours: DataFrame
    report: DataFrame


def confusion(rows: DataFrame, max_group: int = 40, max_neighbours: int = 16) -> Confusion:
    """What may be taken for something else of the same winery, by names and grapes alone (rows: slug, name, winery, grapes, category, index_ready).

    Groups have equal names or slugs but for years, equal grapes and category, or equal words beyond those that all share;
    pairs have like words in names or slugs. Groups aren't joined to larger ones. Groups of more than max_group slugs say too
    little and are only counted, so the pairs of a group are bounded. Rows that aren't ready or have no winery are left out;
    a slug that repeats is an error.
    """
    ready = rows.where("index_ready")
    require_none(ready.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1"), "a slug repeats")
    words = lambda c: T.words(F.coalesce(F.col(c), F.lit("")))
    none = F.array().cast("array<string>")
    told = ready.select(
        "slug", words("winery").alias("winery"), T.without_years(words("name")).alias("name"), T.without_years(words("slug")).alias("slug_words"), F.array_sort(F.array_distinct(words("grapes"))).alias("grapes"), words("category").alias("category")
    ).where(F.size("winery") > 0)
    common = F.array(*map(F.lit, COMMON_WORDS))
    known = F.concat("grapes", "category", "winery", common)
    series = F.filter("name", lambda t: ~F.array_contains(known, t) & ~t.rlike("^[0-9]+$"))
    signature = lambda reason, value, able: F.when(able, F.struct(F.lit(reason).alias("reason"), value.alias("signature")))
    kinds = F.array(
        signature("same_name_without_vintage", F.col("name"), F.size("name") > 0),
        signature("same_slug_without_vintage", F.col("slug_words"), F.size("slug_words") > 0),
        signature("same_grapes_category", F.concat("grapes", F.array(F.lit("|")), "category"), (F.size("grapes") > 0) & (F.size("category") > 0)),
        signature("same_series_tokens", series, F.size(series) >= 2),
    )
    told = written(told, "told")
    tagged = told.select("slug", "winery", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("slug", "winery", "k.reason", "k.signature")
    sizes = written(tagged.groupBy("reason", "winery", "signature").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    key = ["reason", "winery", "signature"]
    groups = written(tagged.join(sizes.where(F.col("n") <= max_group), key).groupBy(*key).agg(F.array_sort(F.collect_list("slug")).alias("slugs")), "groups")  # max_group slugs at most
    beyond = lambda c: F.array_sort(F.array_distinct(F.array_except(c, F.concat("winery", common))))
    sets = written(told.select("slug", "winery", F.to_json("winery").alias("block"), beyond(F.col("name")).alias("name"), beyond(F.col("slug_words")).alias("slug_words")), "sets")
    near = {f"near_{field}_tokens": _similar_classes(sets, words_of, NEAR, NEAR_COMMON) for field, words_of in (("name", "name"), ("slug", "slug_words"))}
    every = groups
    for reason, (members, links) in near.items():
        of = lambda side, at, members=members: members.select(F.col("class").alias(at), F.col("slug").alias(side))
        met = links.select("x", "y").join(of("a", "x"), "x").join(of("b", "y"), "y").where("x != y or a < b")
        pair = F.array(F.least("a", "b"), F.greatest("a", "b"))
        named = met.join(sets.select(F.col("slug").alias("x"), "winery"), "x")
        every = every.unionByName(named.select(F.lit(reason).alias("reason"), "winery", pair.alias("signature"), pair.alias("slugs")))
    identity = F.concat(F.lit('["'), "reason", F.lit('",'), F.to_json("winery"), F.lit(","), F.to_json("signature"), F.lit(","), F.to_json("slugs"), F.lit("]"))
    clusters = every.select(short_id(identity).alias("cluster_id"), *key, "slugs")
    neighbours = _nearest_of_groups(sets, groups, near, max_neighbours)
    counts = groups.groupBy("reason").agg(F.count("*").alias("n"))
    for reason, (_, links) in near.items():
        pairs = F.when(F.col("x") == F.col("y"), F.col("n_x") * (F.col("n_x") - 1) / 2).otherwise(F.col("n_x") * F.col("n_y"))
        counts = counts.unionByName(links.agg(F.coalesce(F.sum(pairs.cast("bigint")), F.lit(0)).alias("n")).where("n > 0").select(F.lit(reason).alias("reason"), "n"))
    counts = written(counts, "counts")
    mapped = lambda df, name: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias(name))  # noqa: E731  a row for each reason
    covered = neighbours.agg(F.count_if(F.col("rank") == 1).alias("covered"), F.count("*").alias("directed_pairs"))
    total = ready.agg(F.count("*").alias("eligible"))
    oversized = sizes.where(F.col("n") > max_group).groupBy("reason").agg(F.count("*").alias("n"))
    report = total.crossJoin(covered).crossJoin(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("clusters"))).crossJoin(mapped(counts, "by_reason")).crossJoin(mapped(oversized, "oversized"))  # one row each
    share = F.coalesce(F.round(F.col("covered") / F.nullif("eligible", F.lit(0)), 6), F.lit(0.0))
    return Confusion(clusters, neighbours, report.select("eligible", "covered", share.alias("fraction"), (F.col("eligible") - F.col("covered")).alias("uncovered"), "clusters", "by_reason", "oversized", "directed_pairs"))


def _similar_classes(sets: DataFrame, tokens: str, least: float, common: int) -> tuple[DataFrame, DataFrame]:
    """members (slug, class) and links (x, y, n_x, n_y): slugs of sets (slug, block, tokens) are one class, named by its least slug, if they have equally many tokens and the same of those that others in the block have too.

    Tokens of one set alone never meet, so how similar two sets are depends on their classes only. Linked classes are those
    whose sets are similar (see similar_pairs()), x < y, and x = y where a class has several slugs that are similar to each
    other. So copies, and sets that differ in tokens of their own, bring no pairs before somebody asks for them.
    """
    posts = sets.select("slug", "block", F.explode(tokens).alias("token"))
    several = posts.groupBy("block", "token").agg(F.count("*").alias("df")).where("df > 1").select("block", "token")
    common_ones = posts.join(several, ["block", "token"]).groupBy("slug").agg(F.array_sort(F.collect_list("token")).alias("shared"))
    rows = sets.select("slug", "block", F.col(tokens).alias("tokens"), F.size(tokens).alias("size")).join(common_ones, "slug", "left")
    rows = written(rows.withColumn("shared", F.coalesce("shared", F.array().cast("array<string>"))), "shared")
    alike = ["block", "shared", "size"]
    sized = written(rows.groupBy(*alike).agg(F.min("slug").alias("class"), F.min_by("tokens", "slug").alias("tokens"), F.count("*").alias("n")), "classes")
    members = written(rows.join(sized.select(*alike, "class"), alike).select("slug", "class"), "members")
    same = F.size("shared")
    inside = (F.col("n") > 1) & (same >= max(common, 1)) & (same / (2 * F.col("size") - same) >= least)
    own = sized.where(inside).select(F.col("class").alias("x"), F.col("class").alias("y"), F.col("n").alias("n_x"), F.col("n").alias("n_y"))
    of = lambda side, n: sized.select(F.col("class").alias(side), F.col("n").alias(n))
    met = similar_pairs(sized, "class", "block", F.col("tokens"), least, common).select(F.col("a").alias("x"), F.col("b").alias("y")).join(of("x", "n_x"), "x").join(of("y", "n_y"), "y")
    return members, written(own.unionByName(met.select("x", "y", "n_x", "n_y")), "links")


def _nearest_of_groups(sets: DataFrame, groups: DataFrame, near: dict[str, tuple[DataFrame, DataFrame]], most: int) -> DataFrame:
    """src, dst, score, reasons, rank: the most best neighbours of each slug in groups (reason, slugs) and in similar classes, by score and then dst.

    All pairs of one reason score alike there, so of those that are best by it only the first by dst can be among the best: a
    class has one list of those, whatever its size. What other reasons a pair has is told by its own sets.
    """
    told = sets.select(F.col("slug").alias("dst"), "name", "slug_words")
    each = groups.select("reason", F.explode("slugs").alias("src"), "slugs").select("reason", "src", F.explode("slugs").alias("dst")).where("src != dst")  # a group's slugs are bounded
    bounded = each.join(told, "dst").groupBy("src").agg(F.collect_list(F.struct("dst", "name", "slug_words", "reason")).alias("bounded"))
    rows = sets.select(F.col("slug").alias("src"), F.col("name").alias("n"), F.col("slug_words").alias("s")).join(bounded, "src", "left")
    lists = []
    for at, (members, links) in enumerate(near.values()):
        over = lambda by: Window.partitionBy(by).orderBy("dst")
        few = lambda df, by: df.withColumn("nth", F.row_number().over(over(by))).where(F.col("nth") <= most + 1).drop("nth")  # noqa: E731  one may be the slug itself
        firsts = few(members.select(F.col("class").alias("y"), F.col("slug").alias("dst")), "y")
        both = links.select("x", "y").unionByName(links.where("x != y").select(F.col("y").alias("x"), F.col("x").alias("y")))
        best = few(both.join(firsts, "y").select("x", "dst"), "x").join(told, "dst").groupBy("x").agg(F.collect_list(F.struct("dst", "name", "slug_words")).alias(f"list_{at}"))
        rows = rows.join(members.select(F.col("slug").alias("src"), F.col("class").alias(f"class_{at}")), "src").join(best.withColumnRenamed("x", f"class_{at}"), f"class_{at}", "left")
        lists.append(F.coalesce(f"list_{at}", F.array().cast(best.schema[f"list_{at}"].dataType)))
    inside = F.coalesce("bounded", F.array().cast(bounded.schema["bounded"].dataType))
    alike = lambda a, b: (F.size(F.array_intersect(a, b)) >= NEAR_COMMON) & (F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)) >= NEAR)
    met = F.filter(F.array_distinct(F.concat(*lists, F.transform(inside, lambda b: F.struct(b["dst"].alias("dst"), b["name"].alias("name"), b["slug_words"].alias("slug_words"))))), lambda m: m["dst"] != F.col("src"))
    reasons = lambda m: F.array_sort(F.array_distinct(F.concat(F.transform(F.filter(inside, lambda b: b["dst"] == m["dst"]), lambda b: b["reason"]), F.when(alike(F.col("n"), m["name"]), F.array(F.lit("near_name_tokens"))).otherwise(F.array().cast("array<string>")), F.when(alike(F.col("s"), m["slug_words"]), F.array(F.lit("near_slug_tokens"))).otherwise(F.array().cast("array<string>")))))
    weight = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    named = rows.select("src", F.transform(met, lambda m: F.struct(m["dst"].alias("dst"), reasons(m).alias("reasons"))).alias("m"))
    scored = F.transform("m", lambda m: F.struct((-F.array_max(F.transform(m["reasons"], lambda r: F.element_at(weight, r)))).alias("less"), m["dst"].alias("dst"), m["reasons"].alias("reasons")))
    best = named.select("src", F.posexplode(F.slice(F.array_sort(scored), 1, most)).alias("at", "m"))
    return best.select("src", "m.dst", (-F.col("m.less")).alias("score"), "m.reasons", (F.col("at") + 1).cast("bigint").alias("rank"))
