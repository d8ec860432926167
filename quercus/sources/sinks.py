"""Writers: JSON lines in a fixed order, indexes with a checked manifest, and the history of what was seen."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quercus.functions.hashing import sha256


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines with columns by name (nulls too) and rows by order; files are ranges of that order."""
    df.select(*sorted(df.columns)).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def replace_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """write_jsonl() beside path, which then takes its place: readers see the old rows or the new ones, never some of both."""
    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}.{uuid.uuid4().hex}", f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    write_jsonl(df, new, order)
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = of(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    there = files.exists(of(path))
    if (there and not files.rename(of(path), of(old))) or not files.rename(of(new), of(path)):
        raise OSError(f"can't put {new} in the place of {path}")
    if there:
        files.delete(of(old), True)


def index_meta(index: DataFrame, catalogue: DataFrame, key: str, version: int, parameters: str) -> DataFrame:
    """version, parameters, entries and a checksum of the catalogue's keys that doesn't need them all in one place."""
    keys = catalogue.agg(F.sum(F.conv(F.substring(sha256(F.col(key).cast("string")), 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    return keys.select(F.lit(version).alias("version"), F.lit(parameters).alias("parameters"), F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")).alias("catalogue")).crossJoin(index.agg(F.count("*").alias("entries")))


def write_index(index: DataFrame, catalogue: DataFrame, path: str, key: str, version: int = 1, parameters: str = "{}") -> None:
    """The index, then its manifest: an index without one is incomplete."""
    index.write.mode("overwrite").parquet(f"{path}/index")
    index_meta(index, catalogue, key, version, parameters).write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str, catalogue: DataFrame, key: str, vector: str, size: int, version: int = 1, parameters: str = "{}") -> DataFrame:
    """The index if version, parameters, catalogue, vector sizes, finiteness and keys are right; else an error that says what isn't."""
    index = spark.read.parquet(f"{path}/index")
    found = spark.read.parquet(f"{path}/meta").first().asDict()
    wanted = index_meta(index, catalogue, key, version, parameters).first().asDict()
    for name, value in wanted.items():
        if found[name] != value:
            raise ValueError(f"index at {path}: {name} is {found[name]}, not {value}")
    fine = F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    if not index.where(~fine).isEmpty():
        raise ValueError(f"index at {path}: a vector has another size or isn't finite")
    if not index.join(catalogue, key, "left_anti").isEmpty():
        raise ValueError(f"index at {path}: a key isn't in the catalogue")
    return index


def remaining(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return new.join(done, key, "left_anti")


def history(rows: DataFrame, key: str, recency: str, most: int = 5) -> DataFrame:
    """The most recent entries, each key once."""
    newest = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(recency)))).where("__n = 1").drop("__n")
    return newest.orderBy(F.desc(recency), F.asc(key)).limit(most)
