"""An extension: files that arrive in a folder become rows of a table of documents.

Each micro-batch is converted as a batch of its own and written to the partition of its
number, so one that is run again replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import base_name
from ..sources import files

SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, files_at_once: int = 10_000):
    """Starts a query that takes what is new and ends; run it again for what comes later. Documents are named by their file's name."""
    arriving = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(folder)

    def take(batch: DataFrame, number: int) -> None:
        name = base_name(F.col("path"))
        rows = batch.select(name.alias("original_source"), F.lower(F.regexp_extract(name, r"([.][^.]+)$", 1)).alias("extension"), F.regexp_replace(name, r"(?<=.)[.][^.]*$", "").alias("stem"), F.col("content").alias("data"))
        known = rows.where(F.col("extension").isin(files.supported_extensions()))
        files.documents(known).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
