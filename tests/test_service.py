import math

from pyspark.sql import functions as F

from quercus.plans import service

WINES = [
    ("katharon-shardone", "Шардоне", "Белое сухое", "Катарон", "Шардоне", "Крым", "k.webp"),
    ("katharon-risling", "Рислинг", "Белое сухое", "Катарон", "Рислинг", "Крым", None),
    ("abrau-bryut", "Брют", "Белое брют", "Абрау", "Шардоне", "Кубань", None),
    ("other-red-suhoe", "Каберне", "Красное сухое", "Другая", "Каберне", None, None),
    ("plain", "Без слов", None, "Никто", None, None, None),
]


def wines(spark):
    return spark.createDataFrame(WINES, "slug string, name string, category string, winery string, grapes string, region string, photo_name string")


def test_search(spark):
    rows = [(1, "a", 0.9, 20.0, 0.9), (1, "b", 0.5, 0.0, 0.9), (2, "a", 0.5, 0.0, 0.9), (2, "b", 0.5, 0.0, 0.9), (3, "c", 0.2, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "query_id int, slug string, v_max double, sift_inliers double, quality double")
    got = {r.query_id: r for r in service.search(df, {"v_max": 10.0}, {"bias": -3.0, "v_max": 10.0}, 0.8).collect()}
    assert (got[1].status, got[1].slug) == ("found", "a") and math.isclose(got[1].confidence, 0.982, abs_tol=1e-4)
    assert (got[2].status, got[2].slug, got[2].margin) == ("uncertain", "a", 0.0)
    assert got[3].status == "not_found" and len(got[1].top5) == 2


def test_analogues(spark):
    asked = spark.createDataFrame([("katharon-shardone",)], "slug string")
    got = service.analogues(wines(spark), asked).orderBy("rank").collect()
    assert got[0].item == "abrau-bryut" and "katharon-risling" not in [r.item for r in got] and "plain" not in [r.item for r in got]
    assert {"same colour", "shared grapes"} <= set(got[0].reasons)
    two = spark.createDataFrame([("r", "Красное", "Тихое", "A", None, None, None), ("w", "Белое", "Тихое", "B", None, None, None)], "slug string, name string, category string, winery string, grapes string, region string, photo_name string")
    near = spark.createDataFrame([("r", "w", 0.8)], "query string, item string, similarity double")
    one = service.analogues(two, two.where("slug = 'r'").select("slug"), visual=near).collect()
    assert [(r.item, round(r.score, 9), r.reasons) for r in one] == [("w", 2.4, ["same category"])]
    assert "katharon-risling" in [r.item for r in service.analogues(wines(spark), asked, other_makers=False).collect()]


def test_pairings_and_cards(spark):
    asked = spark.createDataFrame([("other-red-suhoe", "рыба", None, None), ("abrau-bryut", "oysters", "oyster sauce", "sweet"), ("plain", "x", None, "Dry")], "slug string, dish string, sauce string, preference string")
    got = {r.slug: r for r in service.pairings(wines(spark), asked).collect()}
    assert (got["other-red-suhoe"].dish_key, got["other-red-suhoe"].verdict) == ("fish", "not_ideal")
    assert (got["abrau-bryut"].style, got["abrau-bryut"].verdict) == ("sparkling", "acceptable")
    assert (got["plain"].style, got["plain"].verdict) == ("white", "good")
    cards = {r.slug: r.image_url for r in service.cards(wines(spark)).collect()}
    assert cards["katharon-shardone"] == "/v1/wines/katharon-shardone/image" and cards["plain"] is None
    one = spark.range(1).select(service.error(F.lit("image_too_large")).alias("e"), service.clamped(F.lit(99)).alias("n")).first()
    assert one.e.status == 413 and one.n == 12
