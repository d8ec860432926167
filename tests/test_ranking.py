import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quercus.operators import evaluate, fit, graph, rank, validate, vectors


@pytest.mark.parametrize("block", [4096, 2])
def test_search_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]  # a tie
    rows = spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(v)], "id bigint, embedding array<double>, label int").repartition(5)
    got = vectors.top_k(rows.where("id % 10 = 0"), rows, 5, "id", "id").collect()
    s = np.round(v @ v.T, 6)
    for q in range(0, 60, 10):
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-s[q, i], i))[:5]
        assert [r.item_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    pooled = {(r.query_id, r.label): r.score for r in vectors.label_scores(rows.where("id % 10 = 0"), rows, "id", "label", item_id="id").collect()}
    assert all(pooled[q, c] == max(s[q, i] for i in range(60) if i != q and i % 4 == c) for q in range(0, 60, 10) for c in range(4))
    assert vectors.top_k(rows.limit(0), rows, 5, "id", "id").count() == 0 and vectors.top_k(rows, rows.limit(0), 5, "id", "id").count() == 0


def test_views_and_projection(spark):
    found = spark.createDataFrame([(1, "a", "x", 0.9, True), (1, "a", "y", 0.5, True), (1, "b", "x", 0.8, False), (1, "b", "y", 0.7, True)], "query_id int, slug string, pair string, score double, usable boolean")
    got = {r.slug: (r.v_max, r.v_mean) for r in vectors.view_scores(found).collect()}
    assert got["a"] == (0.9, 0.7) and got["b"] == (0.8, 0.75)
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id int, embedding array<double>")
    out = {r.id: r.embedding for r in vectors.projected(rows, np.eye(2) * 2).collect()}
    assert out == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None}


def test_softmax_margin_and_decision(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, 3), (1, "b", 0.8, 0)], "query_id int, slug string, v_mean double, inliers int")
    p = rank.softmax(rows, rank.logit({"v_mean": 25.0, "inliers": 1.5}, rows.columns))
    assert math.isclose(sum(r.p for r in p.collect()), 1)
    m = rank.margins(p).first()
    assert m.best == "a" and math.isclose(m.margin, 2 * m.p1 - 1) and math.isclose(m.confidence_top5, 1)
    cases = spark.createDataFrame([(0.9, 0.5, 0.9), (0.5, 0.1, None), (0.5, 0.9, 0.6), (0.9, 0.9, 0.4)], "c double, q double, k double")
    assert [r[0] for r in cases.select(rank.decision(F.col("c"), F.col("q"), F.col("k"))).collect()] == ["found", "low_quality", "uncertain", "not_found"]


def test_gate_references_and_cascade(spark):
    rows = [(1, "a", 8, 30.0), (1, "b", 1, 1.0), (2, "a", 100, 100.0), (2, "b", 80, 80.0), (3, "a", 30, 30.0), (3, "b", 15, 15.0), (4, "a", 50, 50.0)]
    found = spark.createDataFrame(rows, "query_id int, slug string, inliers int, score double")
    strong = rank.strong_match(found)
    assert [(r.query_id, r.slug, round(r.confidence, 3)) for r in strong.collect()] == [(3, "a", 0.85)]
    refs = spark.createDataFrame([(1, "a", 5, 9), (1, "a", 5, 11), (1, "a", 4, 90)], "query_id int, slug string, inliers int, matches int")
    assert rank.best_reference(refs).first()[2:] == (5, 11)
    visual = spark.createDataFrame([(q, "v", 0.5) for q in (1, 3)], "query_id int, slug string, confidence double")
    got = {r.query_id: (r.slug, r.method) for r in rank.cascade(found, [("local", strong), ("visual", visual)]).collect()}
    assert got == {1: ("v", "visual"), 2: (None, None), 3: ("a", "local"), 4: (None, None)}


def test_features(spark):
    rows = spark.createDataFrame(
        [(1, "a", 0.9, 9, 12, 3.0, ["x", "y"]), (1, "b", 0.8, None, None, 1.0, ["x"]), (1, "c", 0.7, 2, 2, None, None)],
        "query_id int, slug string, v_mean double, inliers int, matches int, t_raw double, matched array<string>",
    ).withColumn("best_text", F.lit(3.0))
    got = {r.slug: r for r in rank.evidence_features(rank.visual_features(rows), F.create_map(F.lit("y"), F.lit(3.0))).collect()}
    assert got["a"].sift_best == 1 and got["b"].sift_best == 0 and got["a"].v_gap == 0 and math.isclose(got["c"].v_rank, -math.log(3))
    assert (got["a"].t_missing, got["b"].t_missing, got["c"].t_missing) == (0.0, 0.75, 1.0)
    assert got["c"].t_present == 0 and math.isclose(got["b"].t_gap, math.log1p(1) - math.log1p(3))
    picked = rank.shortlist(rows.withColumn("t", F.col("t_raw")), "v_mean", "t", "slug", 1, 2)
    assert sorted(r.slug for r in picked.collect()) == ["a", "b"]


def test_ratio_matches(spark):
    rows = [(1, "a", 0, 10, 0.1, 1), (1, "a", 0, 11, 0.9, 2), (1, "a", 1, 10, 0.05, 1), (1, "a", 1, 12, 0.9, 2), (1, "a", 2, 13, 0.8, 1), (1, "a", 2, 14, 0.9, 2)]
    got = rank.ratio_matches(spark.createDataFrame(rows, "query_id int, slug string, point int, train int, distance double, nth int")).collect()
    assert [(r.train, r.point) for r in got] == [(10, 1)]


def test_metrics(spark):
    truth = spark.createDataFrame([("1", "a", ["a", "b"]), ("2", "b", ["a", "b"]), ("3", "b", ["b", "a"])], "query_id string, expected string, candidates array<string>")
    predicted = spark.createDataFrame([("1", "a", 10.0), ("2", "a", 20.0), ("3", "b", 30.0)], "query_id string, predicted string, latency double")
    rows = evaluate.joined(truth, predicted)
    s = evaluate.summary(rows).first()
    assert (s.n, round(s.accuracy, 3), round(s.macro_f1, 3)) == (3, 0.667, 0.667)
    c = evaluate.candidate_metrics(rows).first()
    assert (c.recall_at_k, round(c.mrr_at_k, 3)) == (1.0, 0.833)
    p = evaluate.percentiles(rows, "latency", []).first()
    assert (p.p50, p.p95, p.max) == (20.0, 29.0, 30.0)
    assert evaluate.floor_rank(rows.withColumn("g", F.lit(1)), "latency", ["g"]).first().p95 == 20.0
    other = spark.createDataFrame([("1", "a", "a"), ("2", "b", "z")], "query_id string, expected string, predicted string")
    assert round(evaluate.summary(other).first().macro_f1, 3) == 0.333
    assert {r["class"]: r.support for r in evaluate.per_class(other).collect()} == {"a": 1, "b": 1, "z": 0}
    missing = evaluate.joined(truth, predicted.where("query_id != '3'"))
    assert missing.where("correct").count() == 1
    codes = evaluate.coverage(truth, predicted.withColumn("query_id", F.concat("query_id", F.lit("x"))), "query_id", "missing_prediction", "extra_prediction")
    assert codes.groupBy("code").count().count() == 2 and codes.count() == 6


def test_percentiles_with_ties(spark):
    import statistics

    rng = np.random.default_rng(2)
    values = {"a": rng.integers(0, 5, 101).tolist(), "b": [7] * 50, "c": [1.5]}
    rows = spark.createDataFrame([(g, float(v)) for g, some in values.items() for v in some] + [("a", None)], "g string, v double").repartition(6)
    got = {r.g: r for r in evaluate.percentiles(rows, "v", ["g"]).collect()}
    for g, some in values.items():
        assert (got[g].p50, got[g].max, got[g].n) == (statistics.median(map(float, some)), max(some), len(some))
        assert math.isclose(got[g].p95, float(np.percentile(some, 95)))


def test_known_unknown(spark):
    rows = spark.createDataFrame([(["a"], ["a", "b"], "found"), (["a"], ["b", "a"], "not_found"), ([], ["a"], "not_found"), ([], ["a"], "found")], "accepted array<string>, candidates array<string>, status string")
    r = evaluate.known_unknown(rows).first()
    assert (r.known, r.top1, r.top5, r.found_known, r.found_right, r.wrong_not_found, r.unknown, r.rejected, r.wrong_found) == (2, 1, 2, 1, 1, 1, 2, 1, 1)


def submission(spark, **files):
    """Inputs of validate() from lists of dicts; columns are all names that occur."""
    out = {}
    for name, rows in files.items():
        columns = sorted({k for r in rows for k in r})
        kind = {"latency_ms": "double", "fields": "array<string>"}
        data = [(n, *(r.get(c) for c in columns)) for n, r in enumerate(rows)]
        out[name] = spark.createDataFrame(data, ", ".join(["pos bigint", *(f"{c} {kind.get(c, 'string')}" for c in columns)]))
    return out


ROW = {"query_id": "q1", "image_path": "q1.jpg", "image_sha256": "A" * 64, "predicted_slug": "a", "latency_ms": 10.0}


def codes(found):
    return sorted((r.code, r.query_id) for r in found.issues.collect())


def test_submissions(spark, tmp_path):
    asked = [{"query_id": " q1 ", "image_path": "q1.jpg", "Label": "a"}, {"query_id": "q2", "image_path": "q2.jpg", "Label": "b"}]
    files = submission(spark, manifest=asked, predictions=[ROW, {**ROW, "query_id": "q2", "image_path": "q2.jpg", "predicted_slug": "b"}], catalogue=[{"slug": "a"}, {"slug": "b"}])
    good = validate.validate(files["manifest"], files["predictions"], "pos", files["catalogue"])
    assert codes(good) == [("checksums_not_verified", None)] and good.status == "valid" and good.mode == "scored"
    assert validate.exit_code(good) == 0 and validate.exit_code(good, fail_on_warnings=True) == 1
    assert "| accuracy | 1.000 |" in validate.markdown(good)
    assert validate.reported(good, str(tmp_path / "good")) is good
    bad = submission(spark, manifest=asked, predictions=[{**ROW, "predicted_slug": "mars", "image_sha256": "x", "fields": ["query_id"]}, ROW, {**ROW, "query_id": "odd id"}], catalogue=[{"slug": "a"}])
    found = validate.validate(bad["manifest"], bad["predictions"], "pos", bad["catalogue"])
    got = codes(found)
    assert ("duplicate_prediction", "q1") in got and ("missing_prediction", "q2") in got and ("extra_prediction", "__invalid_row_2") in got and ("unknown_expected_slug", "q2") in got
    assert validate.exit_code(found) == 1
    with pytest.raises(ValueError, match="errors"):
        validate.reported(found, str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "bad/issues")).count() == len(got) and "invalid" in (next((tmp_path / "bad/report").glob("*.txt"))).read_text()
    fields = bad["predictions"]
    listed = validate.validate(bad["manifest"], fields, "pos", bad["catalogue"], fields="fields")
    assert [r.detail for r in listed.issues.where("code = 'missing_prediction_field' and row = 0").orderBy("detail").collect()] == ["image_path", "image_sha256", "latency_ms", "predicted_slug"]


def test_submission_odd_inputs(spark):
    none = submission(spark, manifest=[{"query_id": "q", "image_path": "x"}], predictions=[ROW])
    empty = validate.validate(none["manifest"].limit(0), none["predictions"].limit(0), "pos")
    assert codes(empty) == [("catalog_not_provided", None), ("empty_query_manifest", None), ("unlabeled_manifest", None)] and empty.totals["query_count"] == 0 and empty.mode == "unlabeled_validation"
    assert "no labels" in validate.markdown(empty)
    typed = none["predictions"].withColumn("latency_ms", F.lit("10")).withColumn("predicted_slug", F.lit(5))  # text and numbers in the wrong places
    got = {c for c, _ in codes(validate.validate(none["manifest"], typed, "pos"))}
    assert {"invalid_latency", "invalid_predicted_slug", "missing_prediction", "extra_prediction"} <= got
    lists = submission(spark, manifest=[{"query_id": "q1", "image_path": "q1.jpg", "image_sha256": "a" * 64}], predictions=[{**ROW, "matches": "b|a"}], candidates=[{"query_id": "q1", "top5": '["a", {"slug": "c"}]'}, {"query_id": "q1", "top5": "z"}])
    found = validate.validate(lists["manifest"], lists["predictions"], "pos", candidates=lists["candidates"])
    assert found.scored.first().candidates == ["a", "c"] and ("duplicate_candidate_query_id", "q1") in codes(found)
    assert found.totals["checksums_matched"] == 1 and ("candidate_top1_mismatch", "q1") not in codes(found)


def test_scenes(spark):
    box = lambda slug, target, *b: (slug, f"sha-{slug}", [float(x) for x in b], target)
    rows = [
        ("a", "train", "a.png", "x", "sx", "shelf", 100, 100, [box("x", True, 40, 40, 60, 60), box("y", False, 0, 0, 20, 100), box("z", False, 80, 0, 100, 100)]),
        ("b", "dev", "../b.png", "x", "sx", "shelf", 100, 100, [box("x", True, 0, 0, 20, 100), box("x", False, 40, 0, 160, 100)]),
        ("c", "test", "c.png", "y", "sx", "single", 100, 100, None),
        ("c", "test", "c.png", "w", "sw", "shelf", 100, 100, []),
    ]
    scenes = spark.createDataFrame(rows, "query_id string, split string, image_path string, expected_slug string, source_sha256 string, scene string, width int, height int, objects array<struct<slug:string,source_sha256:string,bbox_xyxy:array<double>,is_target:boolean>>")
    contents = spark.createDataFrame([("a.png", "h"), ("../b.png", "h")], "path string, sha256 string").withColumnRenamed("path", "image_path")
    got = sorted((r.query_id, r.code) for r in evaluate.dataset_issues(scenes, contents).collect())
    want = [("b", c) for c in ("invalid_bounds", "invalid_distractors", "invalid_split", "missing_or_unsafe_image")]
    assert got == want + [("c", c) for c in ("duplicate_query_id", "duplicate_query_id", "invalid_centre_label", "missing_or_unsafe_image", "missing_or_unsafe_image")]
    assert sorted((r.kind, r.key, r.splits) for r in evaluate.crossing(scenes).collect()) == [("class", "x", ["dev", "train"]), ("class", "y", ["test", "train"]), ("source", "sha-x", ["dev", "train"]), ("source", "sx", ["dev", "test", "train"])]


def test_confusion(spark):
    rows = [(f"a-{y}", f"Alpha Reserve {y}", "Dom", "Merlot; Pinot", "red", True) for y in (2018, 2019)]
    rows += [("beta", "Beta Gold Oak Cask", "Dom", "", "red", True), ("beta-x", "Beta Gold Oak Barrel Cask", "Dom", "", "red", True), ("gamma", "Alpha Reserve", "Other", "Merlot, Pinot", "red", True), ("off", "Alpha Reserve 2020", "Dom", "Merlot", "red", False), ("none", "Alpha", "", "", "", True)]
    rows += [(f"many-{i}x", "Common", "Big", "Syrah", "red", True) for i in range(6)]
    df = spark.createDataFrame(rows, "slug string, name string, winery string, grapes string, category string, index_ready boolean")
    found = graph.confusion(df, max_group=5, max_neighbours=4)
    clusters = {(r.reason, tuple(r.slugs)) for r in found.clusters.collect()}
    assert clusters == {(x, ("a-2018", "a-2019")) for x in ("same_name_without_vintage", "same_slug_without_vintage", "same_grapes_category", "same_series_tokens", "near_name_tokens")} - {("near_name_tokens", ("a-2018", "a-2019"))} | {("near_name_tokens", p) for p in (("a-2018", "a-2019"), ("beta", "beta-x"))}
    near = {(r.src, r.dst): (r.score, r.reasons) for r in found.neighbours.collect()}
    assert near["beta", "beta-x"] == (0.8, ["near_name_tokens"]) and near["a-2018", "a-2019"][0] == 1.0 and len(near) == 4
    report = found.report.first()
    assert (report.eligible, report.covered, report.fraction, report.oversized) == (12, 4, 0.333333, {"same_grapes_category": 1, "same_name_without_vintage": 1})
    assert graph.confusion(df.limit(0)).report.first().fraction == 0.0
    with pytest.raises(ValueError, match="repeats"):
        graph.confusion(df.union(df))


def test_similar_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice("xy"), sorted({rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 7))} | {"common"})) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, block string, t array<string>").repartition(3)
    for least, common in ((0.3, 1), (0.65, 2), (0.5, 3), (1.0, 1)):
        got = {(r.a, r.b): (round(r.score, 9), r.common) for r in graph.similar_pairs(df, "id", "block", F.col("t"), least, common).collect()}
        want = {}
        for i, x, s in rows:
            for j, y, t in rows:
                n = len({*s} & {*t})
                if i < j and x == y and n >= common and n / len({*s} | {*t}) >= least:
                    want[i, j] = (round(n / len({*s} | {*t}), 9), n)
        assert got == want and want


def test_legacy_cascade(spark):
    queries = spark.createDataFrame([(i, i == 4) for i in range(7)], "query_id int, side_objects boolean")
    of = lambda *ids: spark.createDataFrame([(i, f"s{i}", 0.5, 0.25) for i in ids], "query_id int, slug string, confidence double, margin double")
    neural = spark.createDataFrame([(i, f"n{i}", 0.1) for i in (3, 4)], "query_id int, slug string, margin double")
    words = spark.createDataFrame([(2, "w2", 9.0, 20.0, False, False, True), (3, "w3", 6.9, 5.0, False, False, True), (5, "w5", 7.0, 0.5, False, False, True)], "query_id int, slug string, score double, margin double, conflict boolean, by_alias boolean, indexed boolean")
    got = {r.query_id: (r.slug, r.method, r.margin) for r in rank.legacy_cascade(queries, of(0), of(0, 1), of(0, 1, 2, 3, 4), neural, words).collect()}
    assert got == {0: ("s0", "fusion", 0.25), 1: ("s1", "local_features", 0.25), 2: ("w2", "ocr", 1.0), 3: ("n3", "dinov2", 0.1), 4: ("s4", "handcrafted", 0.25), 5: ("w5", "ocr", 0.05), 6: (None, None, None)}


def test_places(spark):
    rows = spark.range(1000).withColumn("position", (F.col("id") * 7919) % 1009)
    got = {r.position: r.place for r in evaluate.places(rows, "position").collect()}
    assert got == {p: n for n, p in enumerate(sorted(got), 1)}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(3)
    edges = {"chain": [(i, i + 1) for i in range(40)], "star": [(100, i) for i in range(40)], "random": rng.integers(0, 80, (60, 2)).tolist(), "none": []}[shape]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a bigint, b bigint")
    got = {r.node: r.root for r in graph.components(rows, "a", "b").collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_splits_and_leaks(spark):
    members = spark.createDataFrame([(1, "a", "test"), (1, "b", None), (2, "c", "test"), (2, "d", "train"), (3, "e", "odd"), (4, "f", "")], "component int, key string, split string")
    got = {r.component: (r.split, r.issue) for r in graph.component_splits(members, {"train": 0.5, "test": 0.5}, "s").collect()}
    assert got[1] == ("test", None) and got[2] == (None, "conflicting_splits") and got[3] == (None, "unknown_split") and got[4][0] in ("train", "test")
    rows = spark.createDataFrame([("train", "x"), ("test", "x"), ("test", "y"), ("test", None)], "split string, sha string")
    assert [(r.key, r.splits) for r in graph.leaks(rows, "split", {"source": F.col("sha")}).collect()] == [("x", ["test", "train"])]
    assert fit.split_weights("train=0.8, test=0.2") == {"train": 0.8, "test": 0.2}
    with pytest.raises(ValueError):
        fit.split_weights("train=0.8,test=0.3")


def test_confusion(spark):
    rows = spark.createDataFrame([(i, "w", "red") for i in range(8)] + [(9, "v", "blue")], "id int, winery string, name string")
    pairs = graph.bucket_pairs(rows, "id", F.concat_ws("|", "winery", "name"), 1.0, "same_name", 20)
    assert graph.bounded_neighbours(pairs, 2).count() == 16
    assert graph.bucket_pairs(rows, "id", F.concat_ws("|", "winery", "name"), 1.0, "same_name", 3).count() == 0
    assert graph.oversized_buckets(rows, "id", F.concat_ws("|", "winery", "name"), 3).count() == 1


def test_fit(spark):
    rng = np.random.default_rng(5)
    rows = []
    for q in range(800):
        x = rng.normal(size=(5, 2))
        z = 2.0 * x[:, 0] - 1.0 * x[:, 1]
        p = np.exp(z) / np.exp(z).sum()
        right = rng.choice(5, p=p)
        rows += [(q, int(i == right), float(x[i, 0]), float(x[i, 1])) for i in range(5)]
    df = spark.createDataFrame(rows, "query_id int, label int, u double, v double")
    w = fit.conditional_logit(df, ["u", "v"])
    assert abs(w["u"] - 2) < 0.5 and abs(w["v"] + 1) < 0.4
    small = spark.createDataFrame([(i, int(i % 2), float(i % 2) + 0.1 * (i % 3)) for i in range(20)], "id int, label int, x double")
    got = {r.id: r.p for r in fit.weighted_logistic(small, ["x"]).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(20))


def test_resumable(spark, tmp_path):
    from quercus.streaming.resume import resumable

    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "query_id string, v int"
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], schema).write.parquet(source)
    run = lambda: resumable(spark.readStream.schema(schema).parquet(source), sink, "query_id", state).awaitTermination()
    run()
    spark.createDataFrame([("b", 9), ("c", 3)], schema).write.mode("append").parquet(source)
    run()
    got = sorted(tuple(r)[:2] for r in spark.read.option("recursiveFileLookup", True).schema(schema).parquet(sink).collect())
    assert got == [("a", 1), ("b", 2), ("c", 3)]


def test_adapter_brings_queries_nearer(spark):
    rng = np.random.default_rng(5)
    gallery = rng.normal(size=(20, 6))
    gallery[:, 5] = 0.1 * rng.normal(size=20)
    noise = rng.normal(size=(200, 6)) * np.array([0.3, 0.3, 0.3, 0.3, 0.3, 4.0])  # the last part says nothing
    labels = rng.integers(0, 20, 200)
    queries = spark.createDataFrame([(f"s{y:02}", (gallery[y] + noise[i]).tolist()) for i, y in enumerate(labels)] + [("s99", [1.0] * 6), ("s01", None)], "slug string, embedding array<double>").repartition(3)
    known = spark.createDataFrame([(f"s{i:02}", g.tolist()) for i, g in enumerate(gallery)], "slug string, embedding array<double>")
    w = fit.adapter(queries, known, steps=12, l2=0.01, rate=0.05)

    def right(m):
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        return float(((unit((gallery[labels] + noise) @ m) @ unit(gallery @ m).T).argmax(axis=1) == labels).mean())

    assert right(w) > right(np.eye(6)) + 0.1
    assert np.array_equal(fit.adapter(queries.limit(0), known, steps=3), np.eye(6))


def test_model_in_workers(spark):
    def load():
        return lambda texts: [[len(t), 1.0] for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id int, text string").repartition(2)
    got = {r.id: r.embedding for r in vectors.embedded(rows, "text", load).collect()}
    assert got[2] is None and got[3] == [0.0, 1.0] and math.isclose(got[1][0], 3 / math.sqrt(10), rel_tol=1e-6)


def test_distractors(spark, monkeypatch):
    import hashlib

    from quercus.operators import recommend

    monkeypatch.setattr(recommend, "TARGETS", 3)
    pool = [(f"s{i % 7}", f"h{i}", f"f{i % 7 % 3}" if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(pool, "slug string, sha256 string, family string").repartition(3)
    targets = df.where("sha256 in ('h1', 'h2', 'h5', 'h9', 'h30')").withColumn("variant", F.lit(3))
    got = {}
    for r in recommend.distractors(targets, df, "x").orderBy("rank").collect():
        got.setdefault(r.target, []).append((r.slug, r.sha256))
    for slug, sha, family in (p for p in pool if p[1] in ("h1", "h2", "h5", "h9", "h30")):
        order = sorted((p for p in pool if p[0] != slug), key=lambda p: (not (family and family == p[2]), hashlib.sha256(f"x\0{sha}\0003\0{p[1]}".encode()).hexdigest()))
        want = []
        for p in order:
            if p[0] not in {w[0] for w in want}:
                want.append((p[0], p[1]))
        assert got[sha] == want[:2]
