"""Catalogue cleaning, reconciliation with media and web snapshots, and audits."""

from __future__ import annotations

import difflib
from bisect import insort
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quercus.functions import text as T
from quercus.functions.tables import written

FIELDS = ["name", "category", "color", "region", "grapes", "description", "winery", "slug", "photo_name"]


def deduplicated(rows: DataFrame, columns: list[str], position: str) -> DataFrame:
    """Rows that agree in all columns once, with source_row (the first position) and n_rows. provenance() has the other positions as rows of their own: a record may stand for a third of a table, too many for a list."""
    return rows.groupBy(*columns).agg(F.min(position).alias("source_row"), F.count("*").alias("n_rows"))


def provenance(rows: DataFrame, records: DataFrame, columns: list[str], position: str) -> DataFrame:
    """source_row (of the record), position for every row. records: deduplicated(), as a written table, so that AQE can split what one record stands for."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return rows.alias("a").join(records.alias("b"), same).select("b.source_row", F.col(f"a.{position}").alias("position"))


def cleaned(rows: DataFrame, columns: list[str], position: str) -> tuple[DataFrame, DataFrame]:
    """Records: rows with cleaned values, once each, with source_row, n_rows and raw_overrides (as the first row had the values that cleaning changed); and all cleaned rows, for provenance()."""
    tidy = rows.select(position, *(F.col(c).alias(f"__{c}") for c in columns), *(T.clean(F.col(c)).alias(c) for c in columns))
    changed = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.when(F.coalesce(F.col(f"__{c}"), F.lit("")) != F.col(c), F.col(f"__{c}")).alias("value")) for c in columns)), lambda e: e["value"].isNotNull()))
    records = tidy.withColumn("__o", changed).groupBy(*columns).agg(F.min(position).alias("source_row"), F.count("*").alias("n_rows"), F.min_by("__o", position).alias("raw_overrides"))
    return records, tidy.select(position, *columns)


def duplicate_statistics(records: DataFrame) -> DataFrame:
    n = F.col("n_rows")
    return records.agg(F.sum(n).cast("bigint").alias("n_rows"), F.count("*").alias("n_unique"), (F.sum(n) - F.count("*")).cast("bigint").alias("n_removed"), F.count_if(n > 1).alias("n_groups"))


def one_to_many(records: DataFrame, key: Column, value: Column) -> DataFrame:
    """key, member: the values of each key that has more than one, a row for each; blank keys and null values don't count."""
    pairs = records.select(key.alias("key"), value.alias("member")).where((F.col("key") != "") & F.col("member").isNotNull()).distinct()
    many = pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return pairs.join(many, "key", "left_semi")


def missing_rows(records: DataFrame, columns: list[str], key: str, rows: Column) -> DataFrame:
    """field, key, rows: a row for each value that is blank or null. One pass over the records."""
    entry = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), (F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias("gone")) for c in columns)))
    return records.select(F.col(key).alias("key"), rows.alias("rows"), entry.alias("e")).where("e.gone").select(F.col("e.field").alias("field"), "key", "rows")


def missing_fields(records: DataFrame, columns: list[str], key: str, rows: Column) -> DataFrame:
    """field, n_missing, n_source_rows."""
    return missing_rows(records, columns, key, rows).groupBy("field").agg(F.count("*").alias("n_missing"), F.sum("rows").cast("bigint").alias("n_source_rows"))


def counters(rows: DataFrame, columns: list[str]) -> DataFrame:
    """field, value, n for several columns in one pass."""
    entry = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(entry.alias("e")).groupBy("e.field", "e.value").agg(F.count("*").alias("n"))


def preferred(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def ambiguous(rows: DataFrame, by: str, content: list[str], original: Column) -> DataFrame:
    """by, n_contents of groups whose originals differ in content."""
    return rows.where(original).groupBy(by).agg(F.count_distinct(F.struct(*content)).alias("n_contents")).where("n_contents > 1")


def blockers(conditions: dict[str, Column]) -> Column:
    """Sorted names of the conditions that hold."""
    return F.array_sort(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())), lambda x: x.isNotNull()))


def archive_index(entries: DataFrame) -> DataFrame:
    """entries (path, size, crc) with file_name, extension, key and is_rendition."""
    name = T.base_name(F.col("path"))
    return entries.withColumns({"file_name": name, "extension": F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)), "key": T.archive_key(name), "is_rendition": T.is_rendition(name)})


def media_decisions(photos: DataFrame, entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """photo_name, status, method, path, size, crc, n_candidates: the archive entry of each photo.

    By the first of these that has candidates: override path, equal key, key that takes the photo's suffix in
    (name_ext), key without separators if it has one form only. Originals go before renditions, then larger size, then path;
    originals that differ in size or checksum make the photo ambiguous. overrides: photo_name, path; a path that the archive
    lacks is an error.
    """
    index = archive_index(entries)
    lost = overrides.join(index, "path", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"the archive lacks the override {lost[0]['path']}")
    asked = photos.select("photo_name").where("photo_name != ''").distinct()
    suffix = F.regexp_extract("photo_name", r"(?<=.)\.([^.]*)$", 1)
    keyed = asked.withColumns({"key": T.media_key(F.col("photo_name")), "with_suffix": F.concat(T.media_key(F.col("photo_name")), F.lit("_"), F.lower(suffix))})
    single = index.groupBy(T.compact(F.col("key")).alias("compact")).agg(F.count_distinct("key").alias("forms"), F.min("key").alias("key")).where("forms = 1").select("compact", "key")
    by = lambda found, n, method: found.select("photo_name", F.lit(n).alias("priority"), F.lit(method).alias("method"), F.col("key").alias("at"))
    ways = (
        by(keyed, 2, "normalized_name")
        .unionByName(by(keyed.where("with_suffix not like '%\\_'").withColumn("key", F.col("with_suffix")), 3, "normalized_name_with_embedded_extension"))
        .unionByName(by(keyed.withColumn("compact", T.compact(F.col("key"))).drop("key").join(single, "compact"), 4, "separator_insensitive_name"))
    )
    found = ways.join(index.withColumnRenamed("key", "at"), "at").drop("at")
    forced = asked.join(overrides, "photo_name").join(index, "path").withColumns({"priority": F.lit(1), "method": F.lit("override")})
    columns = ["photo_name", "priority", "method", "path", "size", "crc", "is_rendition"]
    every = found.select(*columns).unionByName(forced.select(*columns))
    first = every.withColumn("__least", F.min("priority").over(Window.partitionBy("photo_name"))).where("priority = __least")
    one = first.groupBy("photo_name").agg(
        F.min(F.struct("is_rendition", (-F.col("size")).alias("order"), "path", "size", "crc", "method")).alias("s"),
        F.count("*").alias("n_candidates"),
        F.count_distinct(F.when(~F.col("is_rendition"), F.struct("size", "crc"))).alias("contents"),
    )
    status = F.when(F.col("s").isNull(), "unresolved").when((F.col("contents") > 1) & (F.col("s.method") != "override"), "ambiguous").otherwise("resolved")
    return asked.join(one, "photo_name", "left").select("photo_name", status.alias("status"), "s.method", "s.path", "s.size", "s.crc", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


#: Keys that are asked for at a time.
ASKED = 1024


def suggestions(unresolved: DataFrame, keys: DataFrame, k: int = 3) -> DataFrame:
    """key, known, score, rank: the k known keys most like each unresolved one (Ratcliff and Obershelp's ratio, then name); always k, if there are as many.

    The unresolved keys go to the known ones in blocks; every task sends on its k best for each key. Of two bounds of the
    ratio that take less time the first that lies below a key's k-th best so far passes a known key over, which loses none.
    """
    source = keys.select(F.col("key").alias("known")).where("known is not null").distinct()
    asked = iter(unresolved.select("key").where("key is not null").distinct().toLocalIterator())
    found = None
    while block := [r[0] for r in islice(asked, ASKED)]:
        shipped = keys.sparkSession.sparkContext.broadcast(sorted(block))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            best: dict[str, list[tuple[float, str]]] = {a: [] for a in shipped.value}
            for batch in batches:
                for known in batch.column(0).to_pylist():
                    matcher = difflib.SequenceMatcher(None, "", known, autojunk=False)  # what is second is prepared once
                    for a, held in best.items():
                        matcher.set_seq1(a)
                        low = -held[-1][0] if len(held) == k else -1.0
                        if matcher.real_quick_ratio() >= low and matcher.quick_ratio() >= low and (score := matcher.ratio()) >= low:
                            insort(held, (-score, known))
                            del held[k:]
            rows = [(a, name, -score) for a, held in best.items() for score, name in held]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["key", "known", "score"])

        part = written(source.mapInArrow(run, "key string, known string, score double"), "suggestions")
        shipped.destroy()
        found = part if found is None else found.union(part)
    if found is None:
        return source.sparkSession.createDataFrame([], "key string, known string, score double, rank int")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc("known")))).where(F.col("rank") <= k)


def merged(official: DataFrame, web: DataFrame, key: str) -> DataFrame:
    """All rows of both by key: official columns as they are (null for rows only on the web), web as a struct, origin."""
    left = official.withColumn("__o", F.lit(True))
    right = web.select(F.col(key), F.struct(*(F.col(c) for c in web.columns)).alias("website_snapshot"))
    origin = F.when(F.col("__o").isNull(), "website").when(F.col("website_snapshot").isNull(), "official").otherwise("both")
    return left.join(right, key, "full_outer").withColumn("origin", origin).drop("__o")


def sole_owners(rows: DataFrame, item: str, owner: str) -> DataFrame:
    """item, owner of items (not null or blank) that have one owner only."""
    return rows.where(F.coalesce(F.col(item), F.lit("")) != "").groupBy(item).agg(F.min(owner).alias(owner), F.max(owner).alias("__last")).where(F.col(owner) == F.col("__last")).drop("__last")


def recoverable(official: DataFrame, web: DataFrame, hashes: DataFrame, assets: DataFrame) -> DataFrame:
    """slug of official rows that may take the web's picture.

    Not ready, media ambiguous or unresolved, picture verified, same name and winery (folded, not blank), an upload, and
    neither its bytes (hashes: slug, sha256) nor its asset (assets: slug, asset) belongs to another slug.
    """
    o = official.where("not index_ready and media_status in ('ambiguous', 'unresolved')").select("slug", T.identity(F.col("name")).alias("name"), T.identity(F.col("winery")).alias("winery"))
    w = web.where("image_sha256 is not null and source_image_path like '%/uploads/%'").select("slug", T.identity(F.col("name")).alias("name"), T.identity(F.col("winery")).alias("winery"), F.col("image_sha256").alias("sha256"), F.col("source_image_path").alias("asset"))
    same = o.join(w, ["slug", "name", "winery"]).where("name != '' and winery != ''")
    return same.join(sole_owners(hashes, "sha256", "slug"), ["slug", "sha256"], "left_semi").join(sole_owners(assets, "asset", "slug"), ["slug", "asset"], "left_semi").select("slug")


def references(candidates: DataFrame, shared: DataFrame, ready: DataFrame) -> DataFrame:
    """candidates (slug, sha256, priority, ...) once for each slug and bytes, without bytes of several slugs and without slugs that aren't ready."""
    one = preferred(candidates, ["slug", "sha256"], [F.asc("priority")])
    return one.join(shared, "sha256", "left_anti").join(ready, "slug", "left_semi")


def quarantined(rows: DataFrame, item: str, owner: str) -> DataFrame:
    """rows with shared: whether another owner has the same item. All owners are marked, not all but one."""
    many = rows.where(F.col(item).isNotNull()).groupBy(item, owner).agg(F.lit(1).alias("__n")).groupBy(item).agg(F.count(owner).alias("__n"))
    many = written(many, "owners")  # a plain join side: AQE can split an item with many rows
    return rows.join(many, item, "left").withColumn("shared", F.coalesce(F.col("__n") > 1, F.lit(False))).drop("__n")


def differing_fields(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """by, members, fields: groups of several rows, and which fields differ in them (folded)."""
    n = [F.count_distinct(T.identity(F.coalesce(F.col(f).cast("string"), F.lit("")))).alias(f"__{f}") for f in fields]
    found = rows.where(F.coalesce(F.col(by).cast("string"), F.lit("")) != "").groupBy(by).agg(F.count("*").alias("members"), *n).where("members > 1")
    return found.select(by, "members", blockers({f: F.col(f"__{f}") > 1 for f in fields}).alias("fields"))


def changed_metadata(declared: DataFrame, computed: DataFrame, key: str, sets: list[str]) -> DataFrame:
    """key of rows whose declared sets aren't those computed; order and null or empty make no difference."""
    same = lambda c: F.array_sort(F.coalesce(F.col(f"d.{c}"), F.array().cast("array<string>"))).eqNullSafe(F.array_sort(F.coalesce(F.col(f"c.{c}"), F.array().cast("array<string>"))))
    return declared.alias("d").join(computed.alias("c"), key).select(key, *(same(c).alias(f"__{c}") for c in sets)).where(~F.array_contains(F.array(*(F.col(f"__{c}") for c in sets)), F.lit(True)) if len(sets) == 1 else F.array_contains(F.array(*(F.col(f"__{c}") for c in sets)), F.lit(False))).select(key)


def alias_issues(aliases: DataFrame, catalogue: DataFrame) -> DataFrame:
    """slug, alias, issue: missing_target, ambiguous_target, alias_collision (one query text for several slugs)."""
    known = catalogue.groupBy("slug").agg(F.count("*").alias("n"))
    checked = aliases.join(known, "slug", "left").select("slug", "alias", F.when(F.col("n").isNull(), "missing_target").when(F.col("n") > 1, "ambiguous_target").alias("issue")).where("issue is not null")
    texts = aliases.withColumn("q", T.query_text(F.col("alias")))
    many = one_to_many(texts, F.col("q"), F.col("slug")).select(F.col("key").alias("q")).distinct()
    return checked.unionByName(texts.join(many, "q", "left_semi").select("slug", "alias", F.lit("alias_collision").alias("issue")))


def reusable_originals(web: DataFrame, entries: DataFrame) -> DataFrame:
    """slug, path: the one archive entry with the snapshot's slug and file name; none if there are several."""
    asked = web.select("slug", T.base_name(F.col("image_path")).alias("file_name"))
    return asked.join(entries, ["slug", "file_name"]).groupBy("slug", "file_name").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("slug", "path")


def last_of(rows: DataFrame, key: str, position: str) -> DataFrame:
    return preferred(rows, [key], [F.desc(position)])


def snapshot_report(rows: DataFrame, expected: int, key: str = "slug") -> DataFrame:
    n = F.count_distinct(key)
    return rows.agg(F.lit(expected).cast("bigint").alias("expected"), n.alias("fetched"), (F.count("*") - n).alias("duplicates"), F.count_if(F.col("status") == "failed").alias("failed"), (n == expected).alias("complete"))


def require_none(rows: DataFrame, message: str) -> None:
    """Raises if there is a row."""
    first = rows.limit(1).collect()
    if first:
        raise ValueError(f"{message}: {first[0].asDict()}")


def merged_sources(rows: DataFrame) -> DataFrame:
    """source_sha256, slug (the first by name), n_slugs, n_rows, issue of rows (source_sha256, declared_sha256, slug): rows of the same bytes are one.

    hash_mismatch: a declared checksum isn't the bytes' own; conflicting_labels: the same bytes under several slugs.
    """
    wrong = F.col("declared_sha256").isNotNull() & (F.lower("declared_sha256") != F.col("source_sha256"))
    found = rows.groupBy("source_sha256", "slug").agg(F.count("*").alias("n"), F.bool_or(wrong).alias("w")).groupBy("source_sha256").agg(F.min("slug").alias("slug"), F.count("slug").alias("n_slugs"), F.sum("n").alias("n_rows"), F.bool_or("w").alias("__w"))
    return found.withColumn("issue", F.when(F.col("__w"), "hash_mismatch").when(F.col("n_slugs") > 1, "conflicting_labels")).drop("__w")


def reference_reasons(rows: DataFrame, min_side: int) -> DataFrame:
    """rows with reason, why a reference can't be trained on (null: it can): the first of missing, not_ready, unsafe_path, unreadable, too_small, conflicting_bytes."""
    many = one_to_many(rows, F.col("sha256"), F.col("slug")).select(F.col("key").alias("sha256")).distinct().withColumn("__many", F.lit(True))
    reason = (
        F.when(F.coalesce("image_path", F.lit("")) == "", "missing").when(~F.coalesce("index_ready", F.lit(False)), "not_ready").when(~T.safe_path(F.col("image_path")), "unsafe_path")
        .when(F.col("width").isNull() | F.col("height").isNull(), "unreadable").when(F.least("width", "height") < min_side, "too_small").when(F.coalesce("__many", F.lit(False)), "conflicting_bytes")
    )
    return rows.join(many, "sha256", "left").withColumn("reason", reason).drop("__many")
