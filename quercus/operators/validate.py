"""Checks of a prediction file against its manifest: every issue that a submission can have, what is left to score, and a report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quercus.functions import text as T
from quercus.functions.tables import written
from quercus.operators import evaluate
from quercus.sources import readers, sinks

# The codes of the issues by how serious they are.
ERRORS = [
    "invalid_query_id",
    "duplicate_query_id",
    "invalid_image_path",
    "unsafe_image_path",
    "invalid_query_checksum",
    "unknown_expected_slug",
    "empty_query_manifest",
    "invalid_candidate_query_id",
    "missing_candidates",
    "duplicate_candidate_query_id",
    "extra_candidate_query_id",
    "missing_prediction_field",
    "invalid_prediction_query_id",
    "duplicate_prediction",
    "invalid_prediction_image_path",
    "invalid_prediction_checksum",
    "invalid_predicted_slug",
    "unknown_predicted_slug",
    "invalid_latency",
    "unknown_candidate_slug",
    "missing_prediction",
    "extra_prediction",
    "image_path_mismatch",
    "image_missing",
    "prediction_checksum_mismatch",
    "source_checksum_mismatch",
    "query_checksum_mismatch",
]
WARNINGS = ["prediction_order", "checksum_not_declared", "candidate_top1_mismatch", "partial_labels", "checksums_not_verified"]
INFOS = ["catalog_not_provided", "unlabeled_manifest"]
# What columns of manifests may be called, and what a prediction must have.
LABELS = ["expected_slug", "true_slug", "ground_truth_slug", "label", "slug"]
CHECKSUMS = ["image_sha256", "sha256", "checksum"]
GROUPS = {"hard_negative_group": ["hard_negative_group", "label_family", "confusion_group"], "group_id": ["group_id"], "group": ["group"]}
FLAGS = ["is_hard_negative", "hard_negative"]
REQUIRED = ["query_id", "image_path", "image_sha256", "predicted_slug", "latency_ms"]
QUERY_ID, HEX64 = r"\A[A-Za-z0-9._-]+\z", r"\A[0-9a-fA-F]{64}\z"

LEVELS = {**dict.fromkeys(ERRORS, "error"), **dict.fromkeys(WARNINGS, "warning"), **dict.fromkeys(INFOS, "info")}
ISSUE = "level string, code string, query_id string, row bigint, detail string"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def issues(rows: DataFrame, checks: dict[str, Column], query_id: Column, row: Column, detail: Column | None = None) -> DataFrame:
    """level, code, query_id, row, detail: one row for each check that a row fails (null passes)."""
    entries = F.array(*(F.when(c, F.struct(F.lit(LEVELS[n]).alias("level"), F.lit(n).alias("code"))) for n, c in checks.items()))
    told = rows.select(query_id.cast("string").alias("query_id"), row.cast("bigint").alias("row"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"), F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
    return told.select("e.level", "e.code", "query_id", "row", "detail")


def status(found: DataFrame) -> DataFrame:
    """errors, warnings, status: one row; any error makes a submission invalid."""
    return found.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings")).withColumn("status", F.when(F.col("errors") > 0, "invalid").otherwise("valid"))


def _firsts(rows: DataFrame, able: Column) -> DataFrame:
    """rows with first, the least position of able rows of the same id. A join with sums, so that an id with many rows isn't one task's work."""
    least = rows.where(able).groupBy("id").agg(F.min("row").alias("first"))
    return rows.join(least, "id", "left")


def manifest_rows(manifest: DataFrame, position: str) -> DataFrame:
    """Manifest rows with id, ok_id, ok_path, first, expected, declared, groups and split: accepted are those with row = first."""
    declared = T.named(manifest, CHECKSUMS)
    label = F.nullif(_strip(T.named(manifest, LABELS)), F.lit(""))
    path = T.named(manifest, ["image_path"])
    rows = manifest.select(
        F.col(position).cast("bigint").alias("row"), _strip(T.named(manifest, ["query_id"])).alias("id"), path.alias("path"), label.alias("expected"), declared.alias("declared"), T.named(manifest, ["split"]).alias("split"),
        *(T.named(manifest, names).alias(g) for g, names in GROUPS.items()), T.lenient_boolean(T.named(manifest, FLAGS)).alias("is_hard_negative"),
    )
    ok_id, ok_path = F.coalesce(F.col("id").rlike(QUERY_ID), F.lit(False)), F.coalesce(_strip(F.col("path")) != "", F.lit(False))
    return _firsts(rows.withColumns({"ok_id": ok_id, "ok_path": ok_path}), F.col("ok_id") & F.col("ok_path"))


def prediction_rows(predictions: DataFrame, position: str, fields: str | None) -> DataFrame:
    """Prediction rows with id (of their own for invalid ones), first, missing fields, cleaned values, embedded candidates and schema_valid. fields: an array column of the fields that a row has (None: all columns)."""
    there = lambda f: F.lit(f in predictions.columns) if fields is None else F.array_contains(fields, f) & F.lit(f in predictions.columns)
    kind = {f.name: f.dataType for f in predictions.schema.fields}
    text = lambda f: F.when(there(f), F.col(f"`{f}`")) if isinstance(kind.get(f), S.StringType) else F.lit(None).cast("string")
    given = lambda f: F.when(there(f), F.col(f"`{f}`")).isNotNull() if f in kind else F.lit(False)
    latency = F.when(there("latency_ms"), F.col("latency_ms").cast("double")) if isinstance(kind.get("latency_ms"), S.NumericType) else F.lit(None).cast("double")
    row = F.col(position).cast("bigint")
    ok_id = F.coalesce(_strip(text("query_id")).rlike(QUERY_ID), F.lit(False))
    blank = F.coalesce(_strip(text("predicted_slug")) == "", F.lit(True))
    rows = predictions.select(
        row.alias("row"),
        F.when(ok_id, _strip(text("query_id"))).otherwise(F.concat(F.lit("__invalid_row_"), row.cast("string"))).alias("id"),
        ok_id.alias("ok_id"),
        F.filter(F.array(*(F.when(~there(f), F.lit(f)) for f in REQUIRED)), lambda f: f.isNotNull()).alias("missing"),
        text("image_path").alias("path"),
        F.coalesce(text("image_path") != "", F.lit(False)).alias("ok_path"),
        F.when(text("image_sha256").rlike(HEX64), F.lower(text("image_sha256"))).otherwise(text("image_sha256")).alias("sha256"),
        F.coalesce(text("image_sha256").rlike(HEX64), F.lit(False)).alias("ok_sha"),
        (given("predicted_slug") & blank).alias("bad_slug"),
        F.when(~blank, _strip(text("predicted_slug"))).alias("predicted"),
        F.when((latency >= 0) & (latency < float("inf")) & ~F.isnan(latency), latency).alias("latency_ms"),
        T.candidate_list(T.named(predictions, evaluate.CANDIDATE_FIELDS)).alias("embedded"),
    )
    valid = (F.size("missing") == 0) & F.col("ok_id") & F.col("ok_path") & F.col("ok_sha") & ~F.col("bad_slug") & F.col("latency_ms").isNotNull()
    return _firsts(rows.withColumn("schema_valid", valid), F.lit(True))


def candidate_rows(candidates: DataFrame, position: str) -> DataFrame:
    """Rows of a file of ranked lists with id, ok_id, candidates and first: accepted are those with row = first."""
    rows = candidates.select(F.col(position).cast("bigint").alias("row"), _strip(T.named(candidates, ["query_id"])).alias("id"), T.candidate_list(T.named(candidates, evaluate.CANDIDATE_FIELDS)).alias("candidates"))
    rows = rows.withColumn("ok_id", F.coalesce(F.col("id").rlike(QUERY_ID), F.lit(False)))
    return _firsts(rows, F.col("ok_id") & F.col("candidates").isNotNull())


@dataclass(frozen=True)
class Result:
    """issues (ISSUE), scored (a row for each accepted query), totals (counts by name), status and mode."""

    issues: DataFrame
    scored: DataFrame
    totals: dict[str, int | None]
    status: str
    mode: str


def validate(
    manifest: DataFrame,
    predictions: DataFrame,
    position: str,
    catalogue: DataFrame | None = None,
    images: DataFrame | None = None,
    checksums: DataFrame | None = None,
    candidates: DataFrame | None = None,
    fields: str | None = None,
) -> Result:
    """All issues of predictions against a manifest, and the rows to score.

    position: the column that orders the rows of each of the three files. catalogue: slug. images: path, sha256 of the
    pictures that there are. checksums: path, sha256 as declared (checksum_for() finds a picture's). candidates: ranked lists,
    which go before those that predictions hold themselves. fields: see prediction_rows(). Of rows with one id the first
    counts; null and empty values are missing ones. Empty tables are allowed. Where rows of one id share the first position,
    each is scored, but a query counts once.
    """
    spark = manifest.sparkSession
    none = F.lit(None)
    known = None if catalogue is None else written(catalogue.select(_strip(F.col("slug")).alias("slug")).where("slug != ''").distinct(), "catalogue")
    unknown = lambda rows, c, code: [] if known is None else [issues(rows.where(F.col(c).isNotNull()).join(known.withColumnRenamed("slug", c), c, "left_anti"), {code: F.lit(True)}, F.col("id"), none, F.col(c))]
    m = written(manifest_rows(manifest, position), "manifest")
    queries = m.where("ok_id and row = first")
    hexed = F.coalesce(F.col("declared").rlike(HEX64), F.lit(True))
    found = [
        issues(
            m,
            {
                "invalid_query_id": ~F.col("ok_id"),
                "duplicate_query_id": F.col("ok_id") & (F.col("row") > F.col("first")),
                "invalid_image_path": F.col("ok_id") & ~F.col("ok_path") & F.coalesce(F.col("row") < F.col("first"), F.lit(True)),
            },
            F.when(F.col("ok_id"), F.col("id")),
            F.col("row"),
        ),
        issues(queries, {"unsafe_image_path": F.col("path").rlike(r"^/|(^|/)\.\.(/|$)"), "invalid_query_checksum": ~hexed}, F.col("id"), F.col("row")),
        *unknown(queries, "expected", "unknown_expected_slug"),
    ]
    p = written(prediction_rows(predictions, position, fields), "predictions")
    firsts = p.where("row = first")
    external = None
    if candidates is not None:
        c = written(candidate_rows(candidates, position), "candidates")
        external = c.where("ok_id and row = first").select("id", F.col("candidates").alias("external"))
        checks = {
            "invalid_candidate_query_id": ~F.col("ok_id"),
            "missing_candidates": F.col("ok_id") & F.col("candidates").isNull(),
            "duplicate_candidate_query_id": F.col("ok_id") & F.col("candidates").isNotNull() & (F.col("row") > F.col("first")),
        }
        found += [issues(c, checks, F.when(F.col("ok_id"), F.col("id")), F.col("row")), issues(external.join(queries.select("id"), "id", "left_anti"), {"extra_candidate_query_id": F.lit(True)}, F.col("id"), none)]
        firsts = firsts.join(external, "id", "left").withColumn("candidates", F.coalesce("external", "embedded"))
    else:
        firsts = firsts.withColumn("candidates", F.col("embedded"))
    firsts = written(firsts, "firsts")
    lost = p.select("id", "row", F.explode("missing").alias("field"))
    found += [
        issues(lost, {"missing_prediction_field": F.lit(True)}, none, F.col("row"), F.col("field")),
        issues(p, {"invalid_prediction_query_id": ~F.col("ok_id"), "duplicate_prediction": F.col("row") > F.col("first")}, F.when(F.col("ok_id"), F.col("id")), F.col("row")),
        issues(
            firsts,
            {"invalid_prediction_image_path": ~F.col("ok_path"), "invalid_prediction_checksum": ~F.col("ok_sha"), "invalid_predicted_slug": F.col("bad_slug"), "invalid_latency": F.col("latency_ms").isNull()},
            F.col("id"),
            F.col("row"),
        ),
        *unknown(firsts, "predicted", "unknown_predicted_slug"),
        *unknown(firsts.select("id", F.explode("candidates").alias("candidate")), "candidate", "unknown_candidate_slug"),
    ]
    gone = evaluate.coverage(queries.select("id"), firsts.select("id"), "id", "missing_prediction", "extra_prediction")
    found += [issues(gone.where(F.col("code") == code), {code: F.lit(True)}, F.col("key"), none) for code in ("missing_prediction", "extra_prediction")]
    moved = evaluate.out_of_order(queries.select("id", "row"), firsts.select("id", "row"), "id", "row").agg(F.count("*").alias("n"))
    found.append(issues(moved, {"prediction_order": F.col("n") > 0}, none, none, F.concat(F.col("n").cast("string"), F.lit(" out of place"))))
    scored, more = _matched(queries, firsts, images, checksums)
    found += more
    n = scored.agg(
        F.count("*").alias("queries"), F.count("expected").alias("labelled"), F.count_if("matched").alias("matched"), F.count_if(F.col("matched") & F.col("predicted").isNull()).alias("null"), F.count_if("checked").alias("checked"),
        F.count_if("agreed").alias("agreed"), F.count_if(F.col("matched") & F.col("candidates").isNotNull()).alias("listed"), F.count_if(F.col("matched") & F.col("schema_valid")).alias("schema_valid"),
    ).first()
    whole = {
        "empty_query_manifest": not n["queries"],
        "catalog_not_provided": catalogue is None,
        "unlabeled_manifest": not n["labelled"],
        "partial_labels": bool(n["labelled"]) and n["labelled"] != n["queries"],
        "checksums_not_verified": bool(n["queries"]) and not n["checked"],
    }
    found.append(spark.createDataFrame([(LEVELS[code], code, None, None, None) for code, holds in whole.items() if holds], ISSUE))
    every = written(reduce(DataFrame.unionByName, found), "issues")
    state = status(every).first()
    total = p.count()
    matched = scored.where("matched and predicted is not null")
    totals = {
        "query_count": queries.count(),
        "prediction_count": total,
        "matched_count": n["matched"],
        "missing_predictions": n["queries"] - n["matched"],
        "extra_predictions": firsts.count() - n["matched"],
        "null_predictions": n["null"],
        "non_null_predictions": n["matched"] - n["null"],
        "catalog_slug_count": None if known is None else known.count(),
        "known_non_null_predictions": n["matched"] - n["null"] if known is None else matched.join(known, matched.predicted == known.slug, "left_semi").count(),
        "predictions_with_candidates": n["listed"],
        "checksums_checked": n["checked"],
        "checksums_matched": n["agreed"],
        "error_count": state["errors"],
        "warning_count": state["warnings"],
        "schema_valid_predictions": n["schema_valid"],
    }
    return Result(every, scored, totals, state["status"], "scored" if n["labelled"] else "unlabeled_validation")


def _matched(queries: DataFrame, firsts: DataFrame, images: DataFrame | None, checksums: DataFrame | None) -> tuple[DataFrame, list[DataFrame]]:
    """scored: every query with its prediction's values (matched, checked and agreed say which there are); and the issues of pairs."""
    hexed = F.coalesce(F.col("declared").rlike(HEX64), F.lit(False))
    q = queries.withColumns({"q_path": _strip(F.col("path")), "q_sha": F.when(hexed, F.lower("declared")), "plain": F.regexp_replace(F.regexp_replace(_strip(F.col("path")), r"\\", "/"), r"^[./]+", "")})
    q = q.select("id", "row", "q_path", "q_sha", "plain", "expected", "split", *GROUPS, "is_hard_negative")
    if checksums is not None:
        declared = readers.checksum_for(q.select(F.col("plain").alias("image_path")), checksums).select(F.col("image_path").alias("plain"), F.col("sha256").alias("listed"))
        q = q.join(declared, "plain", "left")
    else:
        q = q.withColumn("listed", F.lit(None).cast("string"))
    if images is not None:
        q = q.join(images.select(F.col("path").alias("q_path"), F.col("sha256").alias("actual")), "q_path", "left")
    else:
        q = q.withColumn("actual", F.lit(None).cast("string"))
    own = firsts.select("id", F.lit(True).alias("matched"), F.col("path").alias("p_path"), "sha256", "predicted", "latency_ms", "candidates", "schema_valid")
    reference = F.col("actual") if images is not None else F.coalesce("q_sha", "listed")
    joined = q.join(own, "id", "left").withColumn("matched", F.coalesce("matched", F.lit(False))).withColumn("checked", F.col("matched") & reference.isNotNull())
    scored = written(joined.withColumn("agreed", F.col("checked") & F.col("sha256").eqNullSafe(reference)), "scored")
    both = scored.where("matched")
    checks = {
        "image_path_mismatch": ~F.col("p_path").eqNullSafe(F.col("q_path")),
        "prediction_checksum_mismatch": F.col("checked") & ~F.col("agreed"),
        "candidate_top1_mismatch": F.coalesce(F.size("candidates") > 0, F.lit(False)) & ~F.get("candidates", 0).eqNullSafe(F.col("predicted")),
    }
    if images is not None:
        seen = F.col("actual").isNotNull()
        checks |= {"image_missing": ~seen, "query_checksum_mismatch": seen & (F.col("q_sha") != F.col("actual"))}
        if checksums is not None:
            checks |= {"checksum_not_declared": seen & F.col("listed").isNull(), "source_checksum_mismatch": seen & (F.col("listed") != F.col("actual"))}
    return scored, [issues(both, checks, F.col("id"), F.lit(None))]




def exit_code(result: Result, fail_on_warnings: bool = False) -> int:
    """0: valid; 1: errors, or warnings where they count. (2 is for files that can't be read.)"""
    return int(result.status != "valid" or (fail_on_warnings and bool(result.totals["warning_count"])))


def markdown(result: Result, most: int = 1000) -> str:
    """A report: totals, metrics where there are labels, latencies, and the issues by code with the first of each (most rows at most)."""
    t = result.totals
    lines = ["# Evaluation", "", f"Status: **{result.status}**, mode: {result.mode}", "", "| Count | Value |", "| --- | ---: |", *(f"| {k} | {'-' if v is None else v} |" for k, v in t.items())]
    if result.mode == "scored":
        labelled = result.scored.where("expected is not null")
        one, listed = evaluate.summary(labelled).first(), evaluate.candidate_metrics(labelled).first()
        lines += ["", "| Metric | Value |", "| --- | ---: |", *(f"| {k} | {v:.3f} |" for k, v in (("accuracy", one["accuracy"]), ("macro F1", one["macro_f1"]), ("recall at 5", listed["recall_at_k"]), ("MRR at 5", listed["mrr_at_k"])) if v is not None)]
    else:
        lines += ["", "There are no labels: the submission is checked, not scored."]
    late = evaluate.percentiles(result.scored, "latency_ms", []).first()
    if late:
        lines += ["", "| Latencies | p50 | p95 | max |", "| ---: | ---: | ---: | ---: |", f"| {late['n']} | {late['p50']:.3f} | {late['p95']:.3f} | {late['max']:.3f} |"]
    found = result.issues.groupBy("level", "code").agg(F.count("*").alias("n"), F.min(F.coalesce("query_id", F.col("row").cast("string"))).alias("first")).orderBy("level", "code").limit(most).collect()
    lines += ["", "| Level | Code | Rows | First |", "| --- | --- | ---: | --- |", *(f"| {r['level']} | {r['code']} | {r['n']} | {r['first'] or '-'} |" for r in found)] if found else ["", "No issues."]
    return "\n".join(lines) + "\n"


def reported(result: Result, path: str, fail_on_warnings: bool = False) -> Result:
    """Writes issues and report under path, and only then raises if the submission fails: what is wrong can be read in any case."""
    spark = result.issues.sparkSession
    sinks.write_jsonl(result.issues, f"{path}/issues", ["level", "code", "query_id", "row"])
    spark.createDataFrame([(markdown(result),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    if exit_code(result, fail_on_warnings):
        raise ValueError(f"{result.totals['error_count']} errors and {result.totals['warning_count']} warnings, see {path}")
    return result
