import math

import numpy as np
from pyspark.sql import functions as F

from quercus.functions import imaging
from quercus.operators import legacy, rank


def test_columns(spark):
    rows = spark.createDataFrame([(0, 5, 5), (9, None, None), (9, 5000, 5000), (9, 10, 500), (9, 500, 500)], "n int, w int, h int")
    assert [r[0] for r in rows.select(imaging.decode_issue(F.col("n"), F.col("w"), F.col("h"), 10_000_000, 64)).collect()] == ["empty_image", "invalid_image", "image_too_large", "image_too_small", None]
    view = spark.createDataFrame([(1000, 500), (300, 500)], "w int, h int").select(imaging.centre_view(F.col("w"), F.col("h")).alias("v")).collect()
    assert [tuple(r.v) for r in view] == [(435, 0, 565, 500), (0, 0, 300, 500)]
    q = spark.createDataFrame([(38.0, 15.0), (5.0, 1.0), (20.0, 1.0)], "c double, s double").select(*imaging.quality(F.col("c"), F.col("s"))).collect()
    assert math.isclose(q[0][0], 1.0) and [r[1] for r in q] == [None, "too_dark", "blurred"]
    w = spark.createDataFrame([(1.0, 0.5, 0.05)], "s double, c double, h double").select(imaging.word_weight(F.col("s"), F.col("c"), F.col("h"))).first()[0]
    assert math.isclose(w, 1.0)
    d = spark.createDataFrame([([1.0, 3.0],)], "d array<double>").select(imaging.root_normalised(F.col("d"))).first()[0]
    assert np.allclose(d, [0.5, math.sqrt(0.75)])


def test_descriptor(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (64, 64, 3), dtype=np.uint8)
    rows = spark.createDataFrame([(1, a.tobytes()), (2, b"short"), (3, None), (4, bytes(64 * 64 * 3))], "id int, pixels binary")
    got = {r.id: r.embedding for r in imaging.described(rows).collect()}
    assert len(got[1]) == 208 and math.isclose(np.linalg.norm(got[1]), 1, rel_tol=1e-5) and got[2] is None and got[3] is None and len(got[4]) == 208


CATALOGUE = [("muskatel", "Мускатель", "Массандра", None, "m.webp"), ("aristov-xiv", "Aristov Domaine XXIV 2019", "Aristov", "Pinot", "a.webp"), ("other", "Каберне 2020", "Дом", "Каберне", None)] + [(f"w{i}", f"Вино номер {i}", f"Дом {i}", None, None) for i in range(4)]


def test_older_ranking(spark):
    wines = spark.createDataFrame(CATALOGUE, "slug string, name string, winery string, grapes string, photo_name string")
    aliases = spark.createDataFrame([("other", "nickname")], "slug string, alias string")
    queries = spark.createDataFrame([(1, "ARISTOV DONAINE"), (2, "Массандра Каберне 2019"), (3, "nickname"), (4, "zzzzzzz"), (5, "")], "query_id int, text string")
    got = {(r.query_id, r["rank"]): r for r in legacy.ranked(queries, legacy.index(wines, aliases)).collect()}
    assert got[1, 1].slug == "aristov-xiv" and "domaine" in got[1, 1].matched and got[1, 1].margin > 0
    second = {r.slug: r for (q, _), r in got.items() if q == 2}
    assert second["other"].producer_conflict and second["other"].vintage_conflict and not second["muskatel"].producer_conflict
    assert got[3, 1].slug == "other" and got[3, 1].by_alias
    assert not any(q in (4, 5) for q, _ in got)
    caps = spark.createDataFrame([(50.0, 9.0, True, False, True), (50.0, 9.0, False, True, True), (50.0, 0.5, False, False, True), (50.0, 9.0, False, False, False)], "s double, m double, c boolean, a boolean, i boolean")
    assert [r[0] for r in caps.select(F.round(rank.text_confidence(*(F.col(x) for x in "smcai")), 4)).collect()] == [0.55, 0.69, 0.75, 0.69]
    assert [r[0] for r in spark.createDataFrame([(0.9, True, True), (0.5, True, True), (0.5, False, True), (0.9, False, False)], "c double, q boolean, i boolean").select(rank.cascade_decision(F.col("c"), F.col("q"), F.col("i"), 0.8)).collect()] == ["found", "low_quality", "uncertain", "uncertain"]
