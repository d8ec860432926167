"""The shared folder, and tables in it that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_quercus_dir", None)
    if own is None:
        own = spark.sparkContext._quercus_dir = tempfile.mkdtemp(prefix="quercus-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/quercus-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


#: Most bytes of a batch that Python gets: tables with long rows would otherwise hold several times the default of 64 MB.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Jobs that run inside send batches of BATCH_BYTES at most to Python."""
    before = spark.conf.get(_BATCH).removesuffix("b")
    if before.isdigit() and 0 < int(before) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def keep_batches_small(spark: SparkSession) -> None:
    """The same from now on, for results that Python makes while the caller reads them."""
    before = spark.conf.get(_BATCH).removesuffix("b")
    if not before.isdigit() or not 0 < int(before) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """df as a table in the shared folder: computed once, without lineage, there after an executor is lost."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    with small_batches(spark):
        df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._quercus_path = path
    return table


def forget(table: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    path = getattr(table, "_quercus_path", None)
    if path:
        jvm = table.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
