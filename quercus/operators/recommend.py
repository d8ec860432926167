"""Analogues and pairings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quercus.functions.tables import written

# What a dish's words say, in the order in which they are tried.
DISH_WORDS = {
    "red_meat": ["beef", "steak", "lamb", "burger", "meat", "мяс", "говяд", "стейк", "баран", "бургер", "шашлык"],
    "poultry": ["chicken", "turkey", "duck", "poultry", "куриц", "индей", "утк", "птиц"],
    "fish": ["fish", "salmon", "tuna", "рыб", "лосос", "тун", "форел"],
    "seafood": ["seafood", "shrimp", "oyster", "морепр", "кревет", "устриц", "мид"],
    "dessert": ["dessert", "cake", "chocolate", "десерт", "торт", "шоколад", "фрукт"],
    "cheese": ["cheese", "сыр"],
    "vegetables": ["vegetable", "salad", "mushroom", "овощ", "салат", "гриб"],
    "spicy": ["spicy", "curry", "asian", "остр", "карри", "азиат"],
    "aperitif": ["aperitif", "snack", "аперитив", "закуск", "фуршет"],
}
# How a style goes with a dish, 0 to 4.
STYLE_KEYS = ["red", "white", "rose", "sparkling", "sweet"]
PAIRING = {
    "red_meat": [4, 1, 2, 1, 0],
    "poultry": [3, 3, 3, 2, 1],
    "fish": [1, 4, 3, 3, 0],
    "seafood": [0, 4, 2, 4, 0],
    "dessert": [1, 1, 1, 2, 4],
    "cheese": [3, 3, 2, 3, 3],
    "vegetables": [2, 4, 3, 3, 1],
    "spicy": [1, 3, 3, 2, 3],
    "aperitif": [1, 3, 3, 4, 1],
    "general": [3, 3, 3, 3, 2],
}
# Sweetness that fits a taste; signs of a sparkling style; serving.
TASTES = {"dry": ["dry", "brut", "extra_brut", "brut_nature"], "sweet": ["semi_sweet", "sweet"], "semi": ["semi_dry", "semi_sweet"]}
SPARKLING = ["игрист", "брют", "brut", "bryut", "петнат", "шампан"]
SERVING = {
    "sparkling": ("6–8 °C", "флюте или тюльпан"),
    "sweet": ("10–12 °C", "небольшой десертный бокал"),
    "red": ("16–18 °C", "бордоский бокал"),
    "rose": ("8–10 °C", "бокал для белого вина"),
    "white": ("8–12 °C", "бокал для белого вина"),
}
RULES_VERSION = "pairing-rules-v2"


def _any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def dish(*texts: Column) -> Column:
    """Category of a dish by the first list with a word that it contains."""
    text = F.lower(F.concat_ws(" ", *texts))
    out = F.lit("general")
    for key, known in reversed(DISH_WORDS.items()):
        out = F.when((text == key) | _any(text, known), key).otherwise(out)
    return out


def style_key(text: Column, category: Column, sweetness: Column, colour: Column) -> Column:
    """sparkling, sweet, red, rose or white of a wine; text: name, category and slug in lower case."""
    kind = F.lower(F.coalesce(category, F.lit("")))
    return (
        F.when(_any(text, SPARKLING), "sparkling")
        .when((F.coalesce(sweetness, F.lit("")) == "sweet") | text.contains("десерт"), "sweet")
        .when((F.coalesce(colour, F.lit("")) == "red") | kind.contains("крас"), "red")
        .when((F.coalesce(colour, F.lit("")) == "rose") | kind.contains("роз"), "rose")
        .otherwise("white")
    )


def serving(style: Column) -> Column:
    known = F.create_map(*[x for k, (t, g) in SERVING.items() for x in (F.lit(k), F.struct(F.lit(t).alias("temperature"), F.lit(g).alias("glass")))])
    return F.try_element_at(known, style)


def pairing_score(dish_key: Column, style: Column) -> Column:
    known = F.create_map(*[F.lit(x) for d, scores in PAIRING.items() for s, n in zip(STYLE_KEYS, scores, strict=True) for x in (f"{d}|{s}", n)])
    return F.coalesce(F.try_element_at(known, F.concat_ws("|", dish_key, style)), F.lit(1))


def taste_fits(sweetness: Column, taste: Column) -> Column:
    out = F.lit(True)
    for name, known in TASTES.items():
        out = F.when(F.lower(F.coalesce(taste, F.lit(""))) == name, sweetness.isNull() | sweetness.isin(known)).otherwise(out)
    return out


def verdict(score: Column, fits: Column) -> Column:
    plain = F.when(score >= 4, "excellent").when(score == 3, "good").when(score == 2, "acceptable").otherwise("not_ideal")
    return F.when(~fits & plain.isin("excellent", "good"), "acceptable").otherwise(plain)


def analogues(items: DataFrame, queries: DataFrame, key: str, rules: list[tuple], maker: str | None, k: int, visual: DataFrame | None = None, visual_weight: float = 0.5) -> DataFrame:
    """query, item, score, reasons, rank: the k items most like each query, by rules that both share.

    rules: reason, value (column, null: none), points, and as a fourth, if wanted, the reason of a rule before it: then it
    counts only for pairs that this other rule doesn't fit. Every other rule that both agree on gives its points, and rows
    meet only on a rule's value, so items without a reason are never paired. An array as a value gives points times Jaccard
    similarity. maker: a column whose equality excludes (null: nothing). visual: query, item, similarity of pictures, which
    adds visual_weight times as much to pairs with a reason. The pairs of one value are its queries times its items; queries
    are the set asked for, not all rows.
    """
    parts = []
    for n, (_, value, *_) in enumerate(rules):
        parts.append(value.alias(f"r{n}"))
    side = lambda df, p: df.select(F.col(key).alias(p), (F.col(maker) if maker else F.lit(None).cast("string")).alias(f"{p}_maker"), *parts)
    q, i = side(queries, "query"), side(items, "item")
    kinds = [dict(q.dtypes)[f"r{n}"].startswith("array") for n in range(len(rules))]
    met = None
    for n, many in enumerate(kinds):
        value = F.explode(f"r{n}") if many else F.col(f"r{n}")
        left, right = q.select("query", value.alias("v")).where("v is not null"), i.select("item", value.alias("v")).where("v is not null")
        part = left.join(right, "v").select("query", "item")
        met = part if met is None else met.union(part)
    a, b = q.alias("a"), i.alias("b")
    pairs = met.distinct().join(a, "query").join(b, "item").where("query != item")
    if maker:
        pairs = pairs.where(F.coalesce(F.col("a.query_maker") != F.col("b.item_maker"), F.lit(True)) | (F.col("a.query_maker") == ""))
    points, reasons, fits = [], [], {}
    for n, (reason, _, worth, *unless) in enumerate(rules):
        x, y = F.col(f"a.r{n}"), F.col(f"b.r{n}")
        fit = F.coalesce(F.arrays_overlap(x, y) if kinds[n] else x == y, F.lit(False))
        for other in unless:
            fit = fit & ~fits[other]
        fits[reason] = fit
        share = F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)) if kinds[n] else F.lit(1.0)
        points.append(F.when(fit, F.lit(worth) * share).otherwise(0.0))
        reasons.append(F.when(fit, reason))
    told = pairs.select("query", "item", sum(points, F.lit(0.0)).alias("score"), F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons")).where(F.size("reasons") > 0)
    if visual is not None:
        near = visual.select("query", "item", F.col("similarity").alias("__v"))
        told = told.join(near, ["query", "item"], "left").withColumn("score", F.col("score") + visual_weight * F.coalesce("__v", F.lit(0.0))).drop("__v")
    return told.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("item"))).cast("bigint")).where(F.col("rank") <= k)


def closest(candidates: Column, known: Column, limit: int) -> Column:
    """The first limit of the candidates that are known, in order, once each."""
    return F.slice(F.array_distinct(F.filter(candidates, lambda s: F.array_contains(known, s))), 1, limit)


def alternatives(pool: DataFrame, k: int = 3) -> DataFrame:
    """query, item, rank from pool (query, item, place, score, own_score, fits, same_maker): what goes better; if nothing does, as good things of other makers."""
    better = pool.where(F.col("fits") & (F.col("score") > F.col("own_score"))).withColumn("kind", F.lit(0))
    same = pool.where(F.col("fits") & (F.col("score") >= F.greatest("own_score", F.lit(3))) & ~F.col("same_maker")).withColumn("kind", F.lit(1))
    every = better.unionByName(same).withColumn("__least", F.min("kind").over(Window.partitionBy("query"))).where("kind = __least")
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("place")).cast("bigint")).where(F.col("rank") <= k).select("query", "item", "rank", F.when(F.col("kind") == 0, "better").otherwise("same").alias("why"))


#: Targets that are compared with the whole pool at a time.
TARGETS = 4096


def distractors(targets: DataFrame, pool: DataFrame, seed: str, k: int = 2) -> DataFrame:
    """target, variant, slug, sha256, rank: k sources of other slugs for each target (slug, sha256, family, variant), as a hash orders them; those of the target's family first.

    pool: slug, sha256, family. Each slug stands once, by its first source. Targets go to the pool in blocks, every task sends
    on its k best of each target: no pair of target and source is a row unless it is among them.
    """
    source, found = iter(targets.select("slug", "sha256", "family", F.col("variant").cast("string")).toLocalIterator()), None
    rows = pool.select("slug", "sha256", "family")
    while block := [tuple(r) for r in islice(source, TARGETS)]:
        shipped = pool.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            best: list[dict[str, tuple[bool, str, str]]] = [{} for _ in shipped.value]
            for batch in batches:
                own = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                for held, (slug, sha, family, variant) in zip(best, shipped.value, strict=True):
                    head = hashlib.sha256(f"{seed}\0{sha}\0{variant}\0".encode())
                    for other, digest, kin in own:
                        if other == slug:
                            continue
                        h = head.copy()
                        h.update(digest.encode())
                        place = (not (family and family == kin), h.hexdigest(), digest)
                        if other not in held and len(held) < k or place < held.get(other, max(held.values(), default=place)):
                            held[other] = place
                            if len(held) > k:
                                del held[max(held, key=held.get)]
            out = [(t[1], t[3], t[0], other, p[2], p[0], p[1]) for t, held in zip(shipped.value, best, strict=True) for other, p in held.items()]
            kinds = (pa.string(),) * 5 + (pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["target", "variant", "of", "slug", "sha256", "stranger", "hash"])

        part = written(rows.mapInArrow(run, "target string, variant string, of string, slug string, sha256 string, stranger boolean, hash string"), "distractors")
        shipped.destroy()
        found = part if found is None else found.union(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], "target string, variant string, slug string, sha256 string, rank int")
    key = ["target", "variant", "of"]
    one = found.groupBy(*key, "slug").agg(F.min(F.struct("stranger", "hash", "sha256")).alias("b"))
    placed = one.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("b.stranger", "b.hash")))
    return placed.where(F.col("rank") <= k).select("target", "variant", "slug", "b.sha256", "rank")
