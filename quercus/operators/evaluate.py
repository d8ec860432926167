"""Scoring of predictions: metrics, slices, percentiles and the algebra of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quercus.functions import text as T
from quercus.functions.tables import written


def joined(truth: DataFrame, predictions: DataFrame, key: str = "query_id") -> DataFrame:
    """Every truth row with its prediction; a missing one is wrong (correct is null-safe)."""
    return truth.join(predictions, key, "left").withColumn("correct", F.col("expected").eqNullSafe(F.col("predicted")) & F.col("expected").isNotNull())


def per_class(rows: DataFrame) -> DataFrame:
    """class, support, predicted_n, tp, precision, recall, f1 over all classes expected or predicted; empty denominators give 0."""
    right = F.sum((F.col("expected") == F.col("predicted")).cast("int")).cast("bigint")
    e = rows.where("expected is not null").groupBy(F.col("expected").alias("class")).agg(F.count("*").alias("support"), right.alias("tp"))
    p = rows.where("predicted is not null").groupBy(F.col("predicted").alias("class")).agg(F.count("*").alias("predicted_n"))
    both = e.join(p, "class", "full_outer").na.fill(0, ["support", "tp", "predicted_n"])
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = both.withColumns({"precision": over(F.col("tp"), F.col("predicted_n")), "recall": over(F.col("tp"), F.col("support"))})
    return out.withColumn("f1", over(2 * F.col("tp"), F.col("support") + F.col("predicted_n")))


def summary(rows: DataFrame) -> DataFrame:
    """n, accuracy (also micro-F1) and macro_f1."""
    correct = F.coalesce((F.col("expected") == F.col("predicted")), F.lit(False))
    return rows.agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("accuracy")).crossJoin(per_class(rows).agg(F.avg("f1").alias("macro_f1")))


def candidate_metrics(rows: DataFrame, k: int = 5) -> DataFrame:
    """n_with_candidates, recall_at_k, mrr_at_k over rows with candidates (null: not covered; empty: a miss)."""
    place = F.array_position(F.slice("candidates", 1, k), F.col("expected"))
    return rows.where("candidates is not null").withColumn("place", place).agg(F.count("*").alias("n_with_candidates"), F.avg((F.col("place") > 0).cast("double")).alias("recall_at_k"), F.avg(F.when(F.col("place") > 0, 1.0 / F.col("place")).otherwise(0.0)).alias("mrr_at_k"))


def slices(rows: DataFrame, group: str) -> DataFrame:
    """group, n, accuracy, n_expected, hard (groups with two or more expected classes)."""
    correct = F.coalesce((F.col("expected") == F.col("predicted")), F.lit(False))
    return rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("accuracy"), F.count_distinct("expected").alias("n_expected")).withColumn("hard", F.col("n_expected") >= 2)


def _sliced(rows: DataFrame, kind: str, name: Column, k: int) -> DataFrame:
    correct = F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False)).cast("double")
    covered = F.col("candidates").isNotNull()
    hit = F.when(covered, F.coalesce(F.array_contains(F.slice("candidates", 1, k), F.col("expected")), F.lit(False)).cast("double"))
    return rows.groupBy(F.lit(kind).alias("slice"), name.cast("string").alias("name")).agg(
        F.count("*").alias("queries"), F.count_distinct("expected").alias("classes"), F.round(F.avg(correct), 3).alias("accuracy"), F.count_if(covered).alias("candidate_coverage"), F.round(F.avg(hit), 3).alias("recall_at_5")
    )


def all_slices(rows: DataFrame, groups: tuple[str, ...] = ("hard_negative_group", "group_id", "group"), k: int = 5) -> DataFrame:
    """slice, name, queries, classes, accuracy, candidate_coverage, recall_at_5 of labelled rows (expected, predicted, candidates; split, is_hard_negative and the group columns where there are).

    Slices: group (by the first group column that has a value in any row), hard_negative (rows of groups with two or more
    expected classes), explicit_hard_negative (rows with the flag), split; and macro_group, whose accuracy is the mean of the
    groups'. Slices without rows are missing.
    """
    labelled = rows.where("expected is not null")
    asked = [g for g in groups if g in rows.columns]
    has = labelled.agg(*(F.count(g).alias(g) for g in asked)).first() if asked else {}
    field = next((g for g in asked if has[g]), None)
    out = []
    if field:
        grouped = labelled.where(F.col(field).isNotNull())
        by = _sliced(grouped, "group", F.col(field), k)
        hard = grouped.groupBy(F.col(field).alias("__g")).agg(F.count_distinct("expected").alias("__n")).where("__n >= 2").select(F.col("__g").alias(field))
        none = F.lit(None)
        macro = by.agg(F.lit("macro_group").alias("slice"), F.lit(field).alias("name"), F.count("*").alias("queries"), none.cast("bigint").alias("classes"), F.round(F.avg("accuracy"), 3).alias("accuracy"), none.cast("bigint").alias("candidate_coverage"), none.cast("double").alias("recall_at_5"))
        out += [by, macro, _sliced(grouped.join(hard, field, "left_semi"), "hard_negative", F.lit(None), k)]
    if "is_hard_negative" in rows.columns:
        out.append(_sliced(labelled.where("is_hard_negative"), "explicit_hard_negative", F.lit(None), k))
    if "split" in rows.columns:
        out.append(_sliced(labelled.where("split is not null"), "split", F.col("split"), k))
    found = out[0] if out else _sliced(labelled.limit(0), "split", F.lit(None), k)
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def method_accuracy(rows: DataFrame, method: str = "method") -> DataFrame:
    """method, n, right, accuracy."""
    right = F.count_if(F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False)))
    return rows.groupBy(F.col(method).alias("method")).agg(F.count("*").alias("n"), right.alias("right"), (right / F.count("*")).alias("accuracy"))


def _at(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """rows with a value, with place in their group (from 1) and __of, the group's size; groups that aren't null."""
    some = rows.where(F.col(value).isNotNull()).select(*by, value)
    placed = places(some, value, by)
    sizes = some.groupBy(*by).agg(F.count("*").alias("__of"), F.max(value).alias("__max"))
    return placed.join(sizes, by) if by else placed.crossJoin(sizes)  # without groups sizes is one row


def percentiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact interpolated p50 and p95, maximum and count. Places come from ranges of values, so that a large group isn't one task's work."""
    placed = _at(rows, value, by)
    spot = lambda q: q * (F.col("__of") - 1)
    at = lambda n: F.max(F.when(F.col("place") == n + 1, F.col(value)))
    near = F.lit(False)
    for q in (0.5, 0.95):
        near = near | F.col("place").isin(F.floor(spot(q)) + 1, F.ceil(spot(q)) + 1)
    found = placed.where(near).groupBy(*by, "__of", "__max").agg(*(at(f(spot(q))).alias(f"__{n}{i}") for i, q in enumerate((0.5, 0.95)) for n, f in (("a", F.floor), ("b", F.ceil))))
    between = lambda i, q: F.col(f"__a{i}") + (spot(q) - F.floor(spot(q))) * (F.col(f"__b{i}") - F.col(f"__a{i}"))
    return found.select(*by, between(0, 0.5).alias("p50"), between(1, 0.95).alias("p95"), F.col("__max").alias("max"), F.col("__of").alias("n"))


def floor_rank(rows: DataFrame, value: str, by: list[str], share: float = 0.95) -> DataFrame:
    """The value at place floor(share (n - 1)) from 0."""
    placed = _at(rows, value, by)
    return placed.where(F.col("place") == F.floor(share * (F.col("__of") - 1)) + 1).select(*by, F.col(value).alias("p95"), F.col("__of").alias("n"))


def confidence_halves(rows: DataFrame, confidence: str, tie: str) -> DataFrame:
    """half, n, accuracy: the floor(n / 2) most confident rows, and the others."""
    placed = places(rows.withColumn("__order", F.struct(-F.col(confidence), tie)), "__order")
    total = placed.count()
    half = F.when(F.col("place") <= total // 2, "top").otherwise("bottom")
    return placed.groupBy(half.alias("half")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def confusions(rows: DataFrame, k: int = 8) -> DataFrame:
    """expected, predicted, n: the k most common errors (of equally common ones the first by names)."""
    wrong = rows.where((F.col("expected") != F.col("predicted")) & F.col("predicted").isNotNull())
    return wrong.groupBy("expected", "predicted").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "expected", "predicted").limit(k)


def known_unknown(rows: DataFrame) -> DataFrame:
    """One row over accepted (array of right answers, empty: not in the catalogue), candidates, status: top-1, top-5, found precision, wrong not-founds, rejected unknowns."""
    known = F.size("accepted") > 0
    top1 = known & F.coalesce(F.array_contains("accepted", F.get("candidates", 0)), F.lit(False))
    top5 = known & F.arrays_overlap("accepted", F.slice("candidates", 1, 5))
    found, lost = F.col("status") == "found", F.col("status") == "not_found"
    return rows.agg(
        F.count_if(known).alias("known"), F.count_if(top1).alias("top1"), F.count_if(F.coalesce(top5, F.lit(False))).alias("top5"), F.count_if(found & known).alias("found_known"),
        F.count_if(found & top1).alias("found_right"), F.count_if(lost & known).alias("wrong_not_found"), F.count_if(~known).alias("unknown"), F.count_if(~known & lost).alias("rejected"), F.count_if(~known & found).alias("wrong_found"),
    )


def coverage(left: DataFrame, right: DataFrame, key: str, missing: str, extra: str) -> DataFrame:
    """code, key: what one side lacks and what the other has beyond."""
    return left.join(right, key, "left_anti").select(F.lit(missing).alias("code"), F.col(key).cast("string").alias("key")).unionByName(right.join(left, key, "left_anti").select(F.lit(extra).alias("code"), F.col(key).cast("string").alias("key")))


def out_of_order(truth: DataFrame, predictions: DataFrame, key: str, position: str) -> DataFrame:
    """key, place_a, place_b of common keys that stand at different places among the common ones.

    Places come from ranges of positions, not from one task that sorts all rows.
    """
    a = places(truth.join(predictions, key, "left_semi"), position).select(key, F.col("place").alias("place_a"))
    b = places(predictions.join(truth, key, "left_semi"), position).select(key, F.col("place").alias("place_b"))
    return a.join(b, key).where("place_a != place_b")


def places(rows: DataFrame, position: str, by: list[str] | None = None) -> DataFrame:
    """rows with place (from 1, in each group of by) by position, from counts of ranges and places within them; rows that tie stand in any order."""
    by = by or []
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())  # parts ranges even where many rows tie
    fixed = written(tied.repartitionByRange(*by, position, "__tie").withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = fixed.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    over = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = sizes.select(*by, "__part", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__before"))
    inner = fixed.withColumn("__in", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(position, "__tie")))
    a, b = inner.alias("a"), before.alias("b")
    same = F.col("a.__part") == F.col("b.__part")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same).select(*(F.col(f"a.{c}") for c in rows.columns), (F.col("__before") + F.col("__in")).cast("bigint").alias("place"))


def dataset_issues(rows: DataFrame, contents: DataFrame | None = None, n_objects: int = 3, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """query_id, code: what is wrong with generated scenes.

    rows: query_id, split, image_path, expected_slug, source_sha256, scene (of several objects: shelf), width, height, objects
    (slug, source_sha256, bbox_xyxy, is_target), and optionally image_sha256, generator, leakage_group. contents: image_path
    and sha256 of the pictures that there are; without it pictures aren't looked at. Classes, sources and families that
    stand in several splits are in crossing().
    """
    centre = lambda o: F.pow((o["bbox_xyxy"][0] + o["bbox_xyxy"][2]) / 2 - F.col("width") / 2, F.lit(2.0)) + F.pow((o["bbox_xyxy"][1] + o["bbox_xyxy"][3]) / 2 - F.col("height") / 2, F.lit(2.0))
    boxed = F.coalesce("objects", F.array().cast(rows.schema["objects"].dataType))
    inside = F.forall(boxed, lambda o: (o["bbox_xyxy"][0] >= 0) & (o["bbox_xyxy"][1] >= 0) & (o["bbox_xyxy"][2] <= F.col("width")) & (o["bbox_xyxy"][3] <= F.col("height")) & (o["bbox_xyxy"][0] < o["bbox_xyxy"][2]) & (o["bbox_xyxy"][1] < o["bbox_xyxy"][3]))
    nearest = F.get(F.array_sort(F.transform(boxed, lambda o: F.struct(centre(o).alias("d"), o["is_target"].alias("is")))), 0)["is"]
    targets = F.filter(boxed, lambda o: o["is_target"])
    several = F.col("scene") == "shelf"
    labelled = (F.size(targets) == 1) & F.coalesce(F.get(targets, 0)["slug"] == F.col("expected_slug"), F.lit(False))
    many = rows.groupBy("query_id").agg(F.count("*").alias("__n"))
    marked = rows.join(many, "query_id")
    checks = [
        F.when(F.col("__n") > 1, "duplicate_query_id"),
        F.when(~F.coalesce(F.col("split").isin(*splits), F.lit(False)), "invalid_split"),
        F.when(several & ~labelled, "invalid_centre_label"),
        F.when(several & labelled & ((F.size(boxed) != n_objects) | (F.size(F.array_distinct(F.transform(boxed, lambda o: o["slug"]))) != n_objects)), "invalid_distractors"),
        F.when(several & labelled & ~inside, "invalid_bounds"),
        F.when(several & labelled & ~F.coalesce(nearest, F.lit(False)), "target_not_central"),
    ]
    if contents is not None:
        declared = F.nullif("image_sha256", F.lit("")) if "image_sha256" in rows.columns else F.lit(None).cast("string")
        newer = F.coalesce(F.col("generator") >= 3, F.lit(False)) if "generator" in rows.columns else F.lit(False)
        marked = marked.join(contents.select("image_path", F.col("sha256").alias("__sha")), "image_path", "left")
        there = F.col("__sha").isNotNull() & T.safe_path(F.col("image_path"))
        checks += [F.when(~there, "missing_or_unsafe_image"), F.when(there & (F.col("__sha") != declared), "image_checksum_mismatch"), F.when(there & declared.isNull() & newer, "missing_image_checksum")]
    return marked.withColumn("__c", F.array(*checks)).select("query_id", F.explode(F.filter("__c", lambda c: c.isNotNull())).alias("code"))


def crossing(rows: DataFrame) -> DataFrame:
    """kind (class, source, family), key, splits: what scenes of dataset_issues(), their objects included, have in more than one split."""
    own = [F.struct(F.lit("class").alias("kind"), F.col("expected_slug").alias("key")), F.struct(F.lit("source").alias("kind"), F.col("source_sha256").alias("key"))]
    if "leakage_group" in rows.columns:
        own.append(F.struct(F.lit("family").alias("kind"), F.nullif("leakage_group", F.lit("")).alias("key")))
    others = F.flatten(F.transform(F.coalesce("objects", F.array().cast(rows.schema["objects"].dataType)), lambda o: F.array(F.struct(F.lit("class").alias("kind"), o["slug"].alias("key")), F.struct(F.lit("source").alias("kind"), o["source_sha256"].alias("key")))))
    pairs = rows.select("split", F.explode(F.concat(F.array(*own), others)).alias("p")).select("split", "p.kind", "p.key").where("key is not null")
    return pairs.groupBy("kind", "key").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def first_reason(conditions: dict[str, Column]) -> Column:
    """Name of the first condition that holds, or null."""
    out = F.lit(None).cast("string")
    for name, c in reversed(conditions.items()):
        out = F.when(c, name).otherwise(out)
    return out


def report(metrics: dict, found: list[dict]) -> str:
    """A Markdown report of a row of metrics and of issue counts."""
    lines = ["# Evaluation", "", "| Metric | Value |", "| --- | ---: |", *(f"| {k} | {v:.4f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in metrics.items())]
    if found:
        lines += ["", "| Level | Code | Rows |", "| --- | --- | ---: |", *(f"| {i['level']} | {i['code']} | {i['n']} |" for i in found)]
    return "\n".join(lines) + "\n"


# What a ranked list of answers may be called.
CANDIDATE_FIELDS = ["candidate_slugs", "top_5", "top5", "top_k", "candidates", "matches"]


def parsed_response(body: Column) -> Column:
    """slug, candidates and error of a prediction service's answer.

    An array is a ranked list: its first name is the answer. An object has slug and may have a list under one of
    CANDIDATE_FIELDS (without one the answer is the list). Anything else is invalid_response; an error's code stays.
    """
    whole = F.try_parse_json(body)
    kind = F.schema_of_variant(whole)
    at = lambda path, t="variant": F.try_variant_get(whole, path, t)
    listed = T.candidate_values(whole)
    text = F.nullif(F.regexp_replace(F.when(F.schema_of_variant(at("$.slug")) == "STRING", at("$.slug", "string")), r"(?U)^\s+|\s+$", ""), F.lit(""))
    filled = lambda v: F.when(~F.coalesce(F.schema_of_variant(v) == "VOID", F.lit(True)) & ~F.coalesce((F.schema_of_variant(v) == "STRING") & (F.try_variant_get(v, "$", "string") == ""), F.lit(False)), v)
    own = F.coalesce(T.candidate_values(F.coalesce(*(filled(at(f"$.{f}")) for f in CANDIDATE_FIELDS))), F.when(text.isNotNull(), F.array(text)))
    is_list, is_object = F.coalesce(kind.startswith("ARRAY"), F.lit(False)), F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    return F.struct(
        F.when(is_list, F.get(listed, 0)).when(is_object, text).alias("slug"),
        F.when(is_list, listed).when(is_object, own).alias("candidates"),
        F.when(~is_list & ~is_object, "invalid_response").when(is_object, at("$.error.code", "string")).alias("error"),
    )


def totals(rows: DataFrame) -> DataFrame:
    """One row: n, labelled, predicted, matched, known, schema_valid, checked (all by columns expected, predicted, known, valid, checked)."""
    return rows.agg(
        F.count("*").alias("n"), F.count("expected").alias("labelled"), F.count("predicted").alias("predicted"), F.count_if(F.col("expected").eqNullSafe(F.col("predicted")) & F.col("expected").isNotNull()).alias("matched"),
        F.count_if("known").alias("known"), F.count_if("valid").alias("schema_valid"), F.count_if("checked").alias("checked"),
    )


def retrieval_by_scene(rows: DataFrame) -> DataFrame:
    """scene, n, top1, top5 from rows (scene, place: the true label's place among unique labels, null: none)."""
    return rows.groupBy("scene").agg(F.count("*").alias("n"), F.count_if(F.col("place") == 1).alias("top1"), F.count_if(F.col("place") <= 5).alias("top5"))
