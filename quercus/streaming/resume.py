"""A resumable sink: rows whose key has been written before are skipped, also after a restart and when a batch runs twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_new(batch: DataFrame, path: str, key: str, number: int) -> None:
    """Writes the rows of a micro-batch whose keys no other batch has written; a batch that runs again replaces its own folder."""
    spark = batch.sparkSession
    rows = batch.dropDuplicates([key])
    if number:
        done = spark.read.schema(batch.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path).select(key, F.col("_metadata.file_path").alias("__f"))
        before = done.where(~F.col("__f").contains(f"/batch={number}/")).select(key).distinct()
        rows = rows.join(before, key, "left_anti")
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def resumable(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Runs over what there is and stops; started again it goes on where it was."""
    return stream.writeStream.foreachBatch(lambda batch, n: append_new(batch, path, key, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
