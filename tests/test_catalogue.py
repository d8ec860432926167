import pytest
from pyspark.sql import functions as F

from quercus.operators import catalog, recommend, textindex
from quercus.sources import readers, sinks


def test_csv_and_deduplication(spark, tmp_path):
    header = ",".join(readers.CSV_FIELDS)
    row = '" Wine",Тихое,Красное,Крым,,"строка\nдве",Дом,{slug},wine.webp'
    path = tmp_path / "c.csv"
    path.write_text("\ufeff" + "\n".join([header, row.format(slug="wine"), row.format(slug="wine"), row.format(slug="other")]) + "\n", encoding="utf-8")
    rows = readers.catalogue_csv(spark, str(path))
    assert [r.source_row for r in rows.orderBy("source_row").collect()] == [2, 3, 4]
    rows = rows.withColumnRenamed("source_row", "pos")
    records, tidy = catalog.cleaned(rows, catalog.FIELDS, "pos")
    found = {r.slug: r for r in records.collect()}
    assert (found["wine"].source_row, found["wine"].n_rows) == (2, 2) and found["wine"].name == "Wine" and found["wine"].raw_overrides == {"name": " Wine"}
    assert sorted(map(tuple, catalog.provenance(tidy, records, catalog.FIELDS, "pos").collect())) == [(2, 2), (2, 3), (4, 4)]
    assert catalog.duplicate_statistics(records).first().asDict() == {"n_rows": 3, "n_unique": 2, "n_removed": 1, "n_groups": 1}
    assert sorted(r.member for r in catalog.one_to_many(records, F.col("photo_name"), F.col("slug")).collect()) == ["other", "wine"]
    missing = {r.field: (r.n_missing, r.n_source_rows) for r in catalog.missing_fields(records, catalog.FIELDS, "slug", F.col("n_rows")).collect()}
    assert missing == {"grapes": (2, 3)}
    path.write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="unexpected columns"):
        readers.catalogue_csv(spark, str(path)).collect()


LISTING = """Path = site/uploads/thumbnail_Vino_krasnoe_0123456789.webp
Size = 100
CRC = 0000AAAA

Path = site/uploads/Vino_krasnoe_0123456789.webp
Size = 1000
CRC = 0000BBBB

Path = site/uploads/random_name_png_0123456789.webp
Size = 5
CRC = 1

Path = site/uploads/A_one_0123456789.webp
Size = 5
CRC = 2

Path = site/uploads/A_one_9876543210.webp
Size = 9
CRC = 3

Path = site/uploads
Folder = +
Size = 0

Path = other/x.webp
Size = 4
"""


def test_media_decisions(spark, tmp_path):
    (tmp_path / "l.txt").write_text(LISTING)
    entries = readers.archive_listing(spark.read.option("lineSep", "\n\n").text(str(tmp_path / "l.txt"))).select("path", "size", "crc")
    assert entries.count() == 5
    photos = spark.createDataFrame([("Вино красное.webp",), ("Vinokrasnoe.webp",), ("random name.png",), ("a one.webp",), ("absent.webp",), ("forced.webp",), ("",)], "photo_name string")
    none = spark.createDataFrame([], "photo_name string, path string")
    forced = spark.createDataFrame([("forced.webp", "site/uploads/A_one_0123456789.webp")], none.schema)
    got = {r.photo_name: r for r in catalog.media_decisions(photos, entries, forced).collect()}
    assert (got["Вино красное.webp"].status, got["Вино красное.webp"].size) == ("resolved", 1000)
    assert got["Vinokrasnoe.webp"].method == "separator_insensitive_name"
    assert got["random name.png"].method == "normalized_name_with_embedded_extension"
    assert (got["a one.webp"].status, got["a one.webp"].size) == ("ambiguous", 9)
    assert got["absent.webp"].status == "unresolved"
    assert got["forced.webp"].method == "override" and "" not in got
    with pytest.raises(ValueError, match="lacks the override"):
        catalog.media_decisions(photos, entries, spark.createDataFrame([("x", "nowhere")], none.schema))
    keys = spark.createDataFrame([("wine_red",), ("wine_rad",), ("beer",), ("wine",)], "key string")
    assert [r.known for r in catalog.suggestions(spark.createDataFrame([("wine_rod",)], "key string"), keys).orderBy("rank").collect()] == ["wine_rad", "wine_red", "wine"]
    odd = spark.createDataFrame([("bab",), ("xay",), ("zzaz",), ("qqq",)], "key string").repartition(3)
    assert [(r.known, round(r.score, 4)) for r in catalog.suggestions(spark.createDataFrame([("aaaa",)], "key string"), odd).orderBy("rank").collect()] == [("bab", 0.2857), ("xay", 0.2857), ("zzaz", 0.25)]
    assert catalog.suggestions(odd.limit(0), odd).count() == 0


def test_suggestions_equal_all_ratios(spark, monkeypatch):
    import difflib
    import random

    monkeypatch.setattr(catalog, "ASKED", 4)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abc_", k=rng.randint(1, 9)))
    asked, known = {word() for _ in range(10)}, {word() for _ in range(80)}
    got = {}
    of = lambda some: spark.createDataFrame([(w,) for w in sorted(some)], "key string").repartition(3)
    for r in catalog.suggestions(of(asked), of(known)).orderBy("rank").collect():
        got.setdefault(r.key, []).append((r.known, r.score))
    for a in asked:
        assert got[a] == sorted(((k, difflib.SequenceMatcher(None, a, k, autojunk=False).ratio()) for k in known), key=lambda x: (-x[1], x[0]))[:3]


def recovery(spark, **changes):
    row = {"name": "Вино", "winery": "Дом", "image_sha256": "h", "source_image_path": "/uploads/a.webp"} | changes
    official = spark.createDataFrame([("a", " вино", "ДОМ", changes.get("media_status", "ambiguous"), False)], "slug string, name string, winery string, media_status string, index_ready boolean")
    web = spark.createDataFrame([("a", row["name"], row["winery"], row["image_sha256"], row["source_image_path"])], "slug string, name string, winery string, image_sha256 string, source_image_path string")
    owners = [("a", "h")] + ([("b", "h")] if changes.get("shared_bytes") else [])
    assets = [("a", "/uploads/a.webp")] + ([("b", "/uploads/a.webp")] if changes.get("shared_asset") else [])
    return catalog.recoverable(official, web, spark.createDataFrame(owners, "slug string, sha256 string"), spark.createDataFrame(assets, "slug string, asset string")).count()


@pytest.mark.parametrize("change", [{"name": "other"}, {"winery": "other"}, {"image_sha256": None}, {"shared_bytes": True}, {"shared_asset": True}, {"source_image_path": "/static/a.webp"}, {"media_status": "resolved"}])
def test_recovery_refusals(spark, change):
    assert recovery(spark, **change) == 0


def test_recovery_and_merge(spark):
    assert recovery(spark) == 1
    official = spark.createDataFrame([("a", "A"), ("b", "B")], "slug string, name string")
    web = spark.createDataFrame([("b", "x"), ("c", "y")], "slug string, name string")
    got = {r.slug: (r.origin, r.name, r.website_snapshot and r.website_snapshot.name) for r in catalog.merged(official, web, "slug").collect()}
    assert got == {"a": ("official", "A", None), "b": ("both", "B", "x"), "c": ("website", None, "y")}
    shared = catalog.quarantined(spark.createDataFrame([("h", "a"), ("h", "c"), ("i", "b"), (None, "d")], "sha string, slug string"), "sha", "slug")
    assert {r.slug: r.shared for r in shared.collect()} == {"a": True, "c": True, "b": False, "d": False}


def test_references(spark):
    rows = spark.createDataFrame([("a", "h", 1, "own"), ("a", "h", 2, "web"), ("a", "i", 2, "web"), ("b", "j", 1, "own"), ("c", "k", 1, "own")], "slug string, sha256 string, priority int, kind string")
    got = catalog.references(rows, spark.createDataFrame([("j",)], "sha256 string"), spark.createDataFrame([("a",), ("b",)], "slug string"))
    assert sorted((r.slug, r.sha256, r.kind) for r in got.collect()) == [("a", "h", "own"), ("a", "i", "web")]


def test_audits(spark):
    rows = spark.createDataFrame([("a", "same.webp", "One", "X", "matched"), ("b", "same.webp", "Two", "Y", "ambiguous"), ("c", "c.webp", "Two", "Y", "matched")], "slug string, photo_name string, name string, winery string, status string")
    assert [r.fields for r in catalog.differing_fields(rows, "photo_name", ["name", "winery"]).collect()] == [["name", "winery"]]
    found = catalog.quarantined(rows, "photo_name", "slug").withColumn("b", catalog.blockers({"media_ambiguous": F.col("status") == "ambiguous", "shared_photo_across_slugs": F.col("shared")}))
    assert {r.slug: r.b for r in found.collect()} == {"a": ["shared_photo_across_slugs"], "b": ["media_ambiguous", "shared_photo_across_slugs"], "c": []}
    declared = spark.createDataFrame([("a", ["x", "y"]), ("b", None), ("c", ["x"])], "slug string, b array<string>")
    computed = spark.createDataFrame([("a", ["y", "x"]), ("b", []), ("c", ["z"])], "slug string, b array<string>")
    assert [r.slug for r in catalog.changed_metadata(declared, computed, "slug", ["b"]).collect()] == ["c"]
    aliases = spark.createDataFrame([("a", "Пино"), ("c", "pino"), ("x", "zzz")], "slug string, alias string")
    got = sorted((r.slug, r.issue) for r in catalog.alias_issues(aliases, rows).collect())
    assert got == [("a", "alias_collision"), ("c", "alias_collision"), ("x", "missing_target")]


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"items": [{"slug": "a"}, {"slug": "b"}]}')
    (tmp_path / "b.txt").write_text("slug;n\na;1\n")
    (tmp_path / "c.jsonl").write_text('{"slug": "a"}\n[1]\n')
    assert readers.records(spark, str(tmp_path / "a.json")).count() == 2
    assert readers.records(spark, str(tmp_path / "b.txt")).columns == ["slug", "n"]
    from pyspark.sql import types as S

    with pytest.raises(Exception, match=r"c.jsonl:2: not a JSON object"):
        readers.strict_jsonl(spark, str(tmp_path / "c.jsonl"), S.StructType([S.StructField("slug", S.StringType())])).collect()
    (tmp_path / "sums").write_text("a" * 64 + " *./x\\y.png\n" + "b" * 64 + "  z/y2.png\n")
    known = readers.checksums(spark, str(tmp_path / "sums"))
    assert {r.path for r in known.collect()} == {"x/y.png", "z/y2.png"}
    asked = spark.createDataFrame([("y.png",), ("z/y2.png",), ("q.png",)], "image_path string")
    assert {r.image_path: r.sha256[0] for r in readers.checksum_for(asked, known).collect()} == {"y.png": "a", "z/y2.png": "b"}
    rows = spark.createDataFrame([(1, "a", None, "T"), (2, "a", "N", None), (3, None, "x", None)], "pos int, slug string, name string, title string")
    assert [(r.slug, r.name) for r in readers.catalogue(rows, "pos").collect()] == [("a", "T")]


def test_listing():
    flat = [{"data": 1}, {"currentPage": 2, "totalItems": 3, "totalPages": 2, "items": 4}, 1, 9, [5], {"slug": 6, "name": 7, "image": -1}, "s", ["Ref", 8], "Name"]
    import json

    assert readers.listing(json.dumps(flat)) == {"currentPage": 1, "totalItems": 9, "totalPages": 1, "items": [{"slug": "s", "name": "Name", "image": None}]}
    assert readers.listing("[]") is None
    deep = [{"currentPage": -1, "totalItems": -1, "totalPages": -1, "items": 1}, *([n] for n in range(2, 3002)), "end"]
    value, depth = readers.listing(json.dumps(deep))["items"], 0
    while isinstance(value, list):
        value, depth = value[0], depth + 1
    assert (value, depth) == ("end", 3000)
    assert readers.resolved([["tag"], ["tag", 2], "x", [0, 1, -4]], 3) == [[], "x", None]
    with pytest.raises(ValueError, match="contains itself"):
        readers.resolved([[1], {"a": 0}], 0)
    with pytest.raises(ValueError, match="a pointer"):
        readers.resolved([[7]], 0)


def test_index_and_history(spark, tmp_path):
    catalogue = spark.createDataFrame([("a",), ("b",)], "slug string")
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "slug string, v array<double>")
    sinks.write_index(index, catalogue, str(tmp_path / "i"), "slug")
    assert sinks.load_index(spark, str(tmp_path / "i"), catalogue, "slug", "v", 2).count() == 2
    with pytest.raises(ValueError, match="catalogue"):
        sinks.load_index(spark, str(tmp_path / "i"), spark.createDataFrame([("a",), ("c",)], "slug string"), "slug", "v", 2)
    with pytest.raises(ValueError, match="another size"):
        sinks.load_index(spark, str(tmp_path / "i"), catalogue, "slug", "v", 3)
    seen = spark.createDataFrame([(i, f"s{i % 7}") for i in range(20)], "t int, slug string")
    assert [r.slug for r in sinks.history(seen, "slug", "t").collect()] == ["s5", "s4", "s3", "s2", "s1"]


WINES = [
    ("massandra-muskatel", "Мускатель", "Массандра", None, "Сладкое"),
    ("katharon-shardone", "Шардоне", "Катарон", "Шардоне", "Белое сухое"),
    ("katharon-risling", "Рислинг", "Катарон", "Рислинг", "Белое сухое"),
    ("other-red-suhoe", "Каберне", "Другая", "Каберне", "Красное сухое"),
]


def test_text_index(spark):
    wines = spark.createDataFrame(WINES, "slug string, name string, winery string, grapes string, category string")
    index = textindex.vocabulary(wines.withColumn("slug2", F.replace("slug", F.lit("-"), F.lit(" "))), {"name": 2.0, "winery": 1.5, "grapes": 0.8, "slug2": 0.8, "category": 0.5}, "slug")
    weights = textindex.idf(index, 4, "slug")
    tokens = spark.createDataFrame([("массанара",), ("катаронрислинг",), ("рислинг",), ("zzzzzz",), ("2019",)], "token string")
    got = {}
    for r in textindex.resolved(tokens, weights).collect():
        got.setdefault(r.token, []).append((r.part, r.key, r.factor))
    assert got["рислинг"] == [(0, "рислинг", 1.0)]
    assert got["массанара"] == [(0, "массандра", 0.6)]
    assert sorted(got["катаронрислинг"]) == [(0, "катарон", 0.8), (1, "рислинг", 0.8)]
    assert set(got) == {"рислинг", "массанара", "катаронрислинг"}
    long = spark.createDataFrame([("x" * 20_000,), ("x" * 19_999 + "y",), ("abcdefgh",), ("abXcdefgh",), ("bcdefgX",)], "token string")
    near = {r.token[:9]: (r.found[:9], r.distance) for r in textindex.nearest_token(long.limit(4), spark.createDataFrame([("x" * 20_000 + "zz",), ("abcdfgh",), ("bcdefgh",)], "token string")).collect()}
    assert near == {"xxxxxxxxx": ("xxxxxxxxx", 2), "abcdefgh": ("abcdfgh", 1), "abXcdefgh": ("abcdfgh", 2)}
    words = spark.createDataFrame([(1, "Катарон", 1.0), (1, "Рислинг", 1.0)], "query_id int, text string, weight double")
    found = {r.slug: r for r in textindex.scored(words, index, weights, textindex.norms(index, weights, "slug"), "slug").collect()}
    assert max(found.values(), key=lambda r: r.score).slug == "katharon-risling"
    assert found["katharon-risling"].matched == ["катарон", "рислинг"] and found["katharon-shardone"].matched == ["катарон"]
    assert 0 < found["katharon-shardone"].coverage < found["katharon-risling"].coverage <= 1
    votes = spark.createDataFrame([(1, 0, "blanc", 0.25), (1, 1, "sélection rouge", 0.9), (2, 0, "dry", 0.1)], "query_id int, pos int, text string, weight double")
    assert [(r.query_id, r.group, r.style) for r in textindex.style_votes(votes).collect()] == [(1, "colour", "red")]


def test_nearest_token_equals_all_distances(spark):
    import random

    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abc", k=n))
    asked, known = {word(rng.randint(3, 11)) for _ in range(150)}, {word(rng.randint(2, 12)) for _ in range(150)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    want = {}
    for a in asked:
        near = sorted((distance(a, k), k) for k in known)
        if len(a) >= 4 and near[0][0] <= (1 if len(a) <= 6 else 2):
            want[a] = near[0]
    of = lambda some: spark.createDataFrame([(w,) for w in sorted(some)], "token string")
    assert {r.token: (r.distance, r.found) for r in textindex.nearest_token(of(asked), of(known)).collect()} == want and len(want) > 50


def test_recommendation(spark):
    rows = spark.createDataFrame([("grilled Salmon",), ("стейк",), ("bread",), ("fish",)], "d string")
    assert [r[0] for r in rows.select(recommend.dish(F.col("d"))).collect()] == ["fish", "red_meat", "general", "fish"]
    one = rows.limit(1).select(
        recommend.verdict(recommend.pairing_score(F.lit("fish"), F.lit("red")), F.lit(True)), recommend.verdict(F.lit(4), F.lit(False)), recommend.taste_fits(F.lit("sweet"), F.lit("Dry")), recommend.taste_fits(F.lit(None).cast("string"), F.lit("dry"))
    ).first()
    assert list(one) == ["not_ideal", "acceptable", False, True]
