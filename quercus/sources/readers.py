"""Readers: catalogue CSV, records of several formats, checksum lists, archive listings, captured pages."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quercus.functions import text as T

# The columns of a catalogue file and what they are called here.
CSV_FIELDS = {
    "Название вина": "name",
    "Категория": "category",
    "Цвет": "color",
    "Регион": "region",
    "Сорт винограда": "grapes",
    "Описание": "description",
    "Винодельня": "winery",
    "Slug": "slug",
    "Название фото": "photo_name",
}
# What an object that wraps a list of records may call it.
CONTAINERS = ["items", "catalog", "queries", "predictions", "records", "wines"]


def catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue's nine columns as strings, with source_row (2 is the first record). Any other header is an error.

    Row numbers need the file's order, and quoted fields may span lines, so each file is one task's work.
    """
    text = spark.read.text(path, wholetext=True)
    fields = list(CSV_FIELDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for batch in batches:
            for value in batch["value"]:
                rows = csv.reader(io.StringIO(value.lstrip("﻿"), newline=""))
                header = next(rows, [])
                if header != fields:
                    raise ValueError(f"unexpected columns: {header}")
                found = [(n, *(r + [""] * 9)[:9]) for n, r in enumerate(rows, 2) if r]
                yield pd.DataFrame(found, columns=["source_row", *CSV_FIELDS.values()])

    return text.mapInPandas(run, ", ".join(["source_row bigint", *(f"{c} string" for c in CSV_FIELDS.values())]))


def delimiter(spark: SparkSession, path: str, lines: int = 20) -> str:
    """The one of tab, comma and semicolon that the first lines have most of."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(lines).collect())
    return max("\t,;", key=lambda d: head.count(d))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a .jsonl, .ndjson, .json (a list, or an object with one), .tsv or .csv file; other names by the delimiter found."""
    lower = path.lower()
    if lower.endswith((".jsonl", ".ndjson")):
        return spark.read.option("mode", "FAILFAST").json(path)
    if lower.endswith(".json"):
        return _unwrapped(spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path))
    sep = "\t" if lower.endswith(".tsv") else "," if lower.endswith(".csv") else delimiter(spark, path)
    return spark.read.options(header=True, sep=sep, multiLine=True, escape='"', encoding="UTF-8").csv(path)


def _unwrapped(df: DataFrame) -> DataFrame:
    for name in CONTAINERS:
        if name in df.columns and isinstance(df.schema[name].dataType, S.ArrayType):
            return df.select(F.inline(name))
    return df


def strict_jsonl(spark: SparkSession, path: str, schema: S.StructType) -> DataFrame:
    """Objects line by line; a line that is no JSON object is an error that names the file and the line's number. Blank lines are left out.

    Line numbers need a file's order: each file is one task's work, in batches of lines.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("lines"))
    lines = text.select("file", F.posexplode("lines").alias("n", "value")).where(F.trim("value") != "")
    bad = ~F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    told = F.concat(F.col("file"), F.lit(":"), (F.col("n") + 1).cast("string"), F.lit(": not a JSON object: "), F.substring("value", 1, 80))
    return lines.select(F.when(bad, F.raise_error(told)).otherwise(F.from_json("value", schema)).alias("r")).select("r.*")


def lenient_jsonl(spark: SparkSession, path: str, schema: S.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def catalogue(rows: DataFrame, position: str) -> DataFrame:
    """Catalogue rows: title stands in for name, strings trimmed, rows without slug or name go, the first row of a slug stays."""
    names = [F.col(c) for c in ("name", "title") if c in rows.columns]
    tidy = rows.withColumn("name", T.first_filled(*names)).withColumn("slug", T.first_filled(F.col("slug"))).where("slug is not null and name is not null")
    strings = {f.name: F.trim(F.col(f.name)) for f in tidy.schema.fields if isinstance(f.dataType, S.StringType)}
    tidy = tidy.withColumns(strings).drop("title") if strings else tidy
    return tidy.withColumn("__n", F.row_number().over(Window.partitionBy("slug").orderBy(position))).where("__n = 1").drop("__n")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 from lines of 64 hex digits and a path; other lines that aren't blank are errors."""
    line = r"^([0-9a-fA-F]{64}) [ *]?(.+)$"
    lines = spark.read.text(path).where(F.trim("value") != "")
    value = F.regexp_replace(F.regexp_replace(F.regexp_extract("value", line, 2), r"\\", "/"), r"^(\./)+", "")
    checked = F.when(F.col("value").rlike(line), F.lower(F.regexp_extract("value", line, 1))).otherwise(F.raise_error(F.concat(F.lit("bad checksum line: "), F.col("value"))))
    return lines.select(F.trim(value).alias("path"), checked.alias("sha256"))


def checksum_for(asked: DataFrame, known: DataFrame, path: str = "image_path") -> DataFrame:
    """path, sha256: of the equal path, else of all known paths that end with it if they agree.

    Suffixes are joined as equal keys: every suffix of a known path at a slash is a row.
    """
    parts = F.split("path", "/")
    ends = known.select("sha256", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("end"))
    found = asked.select(F.col(path).alias("end")).distinct().join(ends, "end")
    exact = F.max(F.when(F.col("path") == F.col("end"), F.col("sha256")))
    agreed = F.when(F.count_distinct("sha256") == 1, F.min("sha256"))
    return found.groupBy(F.col("end").alias(path)).agg(F.coalesce(exact, agreed).alias("sha256"))


def name_lists(spark: SparkSession, path: str) -> DataFrame:
    """slug, alias from a JSON object of lists of strings."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>", {"mode": "FAILFAST"})).alias("slug", "names")).select("slug", F.explode("names").alias("alias"))


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """photo_name, path from a JSON object of strings."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})).alias("photo_name", "path"))


def archive_listing(lines: DataFrame) -> DataFrame:
    """path, size, packed_size, modified, crc from blocks (column value) of Key = value lines; only files under uploads.

    Read blocks with lineSep two line ends. Of a key that repeats in a block the last counts.
    """
    pairs = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.struct(F.trim(F.substring_index(x, " =", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^.*? =", "")).alias("v"), x.contains(" =").alias("is"))), lambda e: e["is"])
    of = lambda key: F.nullif(F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(F.col("__p"), lambda e: e["k"] == key), lambda e: e["v"])), -1), F.lit(""))
    path = F.regexp_replace(of("Path"), r"\\", "/")
    rows = lines.select(pairs.alias("__p")).select(path.alias("path"), of("Size").cast("bigint").alias("size"), of("Packed Size").try_cast("bigint").alias("packed_size"), of("Modified").alias("modified"), F.upper(of("CRC")).alias("crc"), F.coalesce(of("Folder"), of("Attributes"), F.lit("-")).alias("kind"))
    return rows.where(F.col("path").contains("/uploads/") & ~F.col("kind").startswith("+") & ~F.col("kind").startswith("D")).drop("kind")


def embedded_payload(html: Column, script_id: str = "__NUXT_DATA__") -> Column:
    """Text of the page's script element with that id; empty without one."""
    return F.regexp_extract(html, f'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1)


def resolved(flat: list, at: int) -> Any:
    """A value of a flat list in which numbers inside objects and lists point to other places.

    Negative pointers are null; a list that begins with a string stands for what its second part points to (an empty list
    without one). Any depth is walked, each place once; a place that contains itself, or a pointer to none, is an error.
    """

    def pointers(value: Any) -> list:
        if isinstance(value, dict):
            return list(value.values())
        if isinstance(value, list):
            return value[1:2] if value and isinstance(value[0], str) else value
        return []

    done: dict[int, Any] = {-1: None}
    inside: set[int] = set()
    walk = [at]
    while walk:
        here = max(walk[-1], -1)
        if here >= len(flat):
            raise ValueError(f"a pointer to place {here} of {len(flat)}")
        value = None if here < 0 else flat[here]
        wanted = [max(p, -1) for p in pointers(value)]
        waiting = next((p for p in wanted if p not in done), None)
        if here in done or waiting is None:
            walk.pop()
            inside.discard(here)
            if here not in done:
                found = [done[p] for p in wanted]
                done[here] = dict(zip(value, found, strict=True)) if isinstance(value, dict) else value if not isinstance(value, list) else found if not (value and isinstance(value[0], str)) else (found or [[]])[0]
            continue
        inside.add(here)
        if waiting in inside:
            raise ValueError(f"place {waiting} contains itself")
        walk.append(waiting)
    return done[max(at, -1)]


def listing(payload: str) -> dict | None:
    """The first object of a flat payload that describes a page of a listing."""
    flat = json.loads(payload)
    wanted = {"currentPage", "totalItems", "totalPages", "items"}
    return next((resolved(flat, n) for n, v in enumerate(flat) if isinstance(v, dict) and wanted <= set(v)), None)


def listings(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with listing: the page's listing as JSON text; null for pages without one."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            found = listing(v) if v else None
            return None if found is None else json.dumps(found, ensure_ascii=False, sort_keys=True)

        return values.map(one)

    payload = embedded_payload(F.col(html))
    return pages.withColumn("listing", F.when(payload != "", run(payload)))


#: What an item of a listing has.
ITEM = "array<struct<slug:string,title:string,category:string,color:string,manufacturer:string,region:string,image:struct<url:string>>>"


def snapshot_rows(listed: DataFrame, page: str, site: str = "", images: str = "", constants: dict[str, str] | None = None) -> DataFrame:
    """One row for each item of the listings; a slug of other signs is an error.

    Addresses are made of site (of the item) and images (of uploaded pictures). constants: columns that all rows share, as
    when and where the listing was seen. Rows aren't ready for the index and their pictures are pending.
    """
    i = listed.select(F.col(page).alias("source_page"), F.explode(F.from_json(F.get_json_object("listing", "$.items"), ITEM)).alias("i")).select("source_page", "i.*")
    slug = F.when(F.col("slug").rlike("^[A-Za-z0-9_-]+$"), F.col("slug")).otherwise(F.raise_error(F.concat(F.lit("unsafe slug: "), F.coalesce("slug", F.lit("null")))))
    some = lambda c: F.coalesce(F.col(c), F.lit("")).alias({"title": "name", "manufacturer": "winery"}.get(c, c))
    path = F.coalesce("image.url", F.lit(""))
    return i.select(
        slug.alias("slug"), *(some(c) for c in ("title", "category", "color", "manufacturer", "region")), F.when(path.startswith("/uploads/"), F.concat(F.lit(images), path)).alias("image_url"),
        T.base_name(path).alias("photo_name"), path.alias("source_image_path"), F.concat(F.lit(f"{site}/wines/"), "slug").alias("source_url"), "source_page",
        *(F.lit(v).alias(c) for c, v in (constants or {}).items()), F.lit(False).alias("index_ready"), F.lit("pending").alias("media_status"),
    )
