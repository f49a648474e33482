"""Checks of corpora and packs, and a pack's metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus_errors(spark: SparkSession, folder: str, expected: DataFrame | None = None) -> DataFrame:
    """What keeps a folder from being a corpus, (error, path): it isn't there, isn't a folder, has no file of a known format, or lacks expected (original_source) files, which are told by their names alone."""
    from ..sources import files

    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    error = "missing_source_dir" if not fs.exists(path) else "not_a_directory" if not fs.getFileStatus(path).isDirectory() else None
    if error is None:
        names = files.discover(spark, folder).select(F.element_at(F.split("original_source", "/"), -1).alias("original_source"))
        if not names.isEmpty():
            absent = spark.createDataFrame([], "original_source string") if expected is None else missing_documents(names, expected)
            return absent.select(F.lit("missing_expected_document").alias("error"), F.col("original_source").alias("path"))
        error = "no_supported_files"
    return spark.createDataFrame([(error, folder)], "error string, path string")


def missing_documents(documents: DataFrame, expected: DataFrame) -> DataFrame:
    """The expected (original_source) that aren't there, each once, in order."""
    return expected.select("original_source").distinct().join(documents.select("original_source"), "original_source", "left_anti").orderBy("original_source")


def integrity(documents: DataFrame, chunks: DataFrame, edges: DataFrame, files: DataFrame, output_files: DataFrame | None = None) -> DataFrame:
    """What is wrong with a pack: (error, path, detail). chunks have full_path, path, chunk_index, previous and next; edges src and dst; files (path) are those that exist."""
    from pyspark.sql import Window

    none = F.lit(None).cast("string").alias("detail")
    absent = lambda name, df, c: df.select(F.col(c).alias("path")).distinct().join(files.select("path"), "path", "left_anti").select(F.lit(name).alias("error"), "path", none)
    errors = absent("missing_document", documents, "full_path").unionByName(absent("missing_chunk", chunks, "path"))
    if output_files is not None:
        errors = errors.unionByName(absent("missing_output", output_files, "path"))
    w = Window.partitionBy("full_path").orderBy("chunk_index")
    seen = chunks.select("path", "previous", "next", F.lag("path").over(w).alias("before"), F.lead("path").over(w).alias("after"))
    for name, own, want in (("bad_previous", "previous", "before"), ("bad_next", "next", "after")):
        errors = errors.unionByName(seen.where(~F.col(own).eqNullSafe(F.col(want))).select(F.lit(name).alias("error"), "path", none))
    targets = documents.select(F.col("full_path").alias("dst")).unionByName(chunks.select(F.col("path").alias("dst")))
    return errors.unionByName(edges.join(targets, "dst", "left_anti").select(F.lit("bad_target").alias("error"), F.col("src").alias("path"), F.col("dst").alias("detail")))


def metrics(documents: DataFrame, chunks: DataFrame, document_edges: DataFrame, chunk_edges: DataFrame) -> DataFrame:
    """One row of a pack's figures. The 95th percentile is the value at place floor(0.95 n) of the sorted token counts (the first at least), so counts of each value are accumulated, not the values."""
    from pyspark.sql import Window

    n = F.col("chunks")
    by_value = chunks.groupBy("tokens_estimate").agg(F.count("*").alias("k"))
    total = by_value.agg(F.sum("k").alias("chunks"), F.sum(F.col("k") * F.col("tokens_estimate")).alias("sum"), F.max("tokens_estimate").alias("most"))
    upto = by_value.withColumn("upto", F.sum("k").over(Window.orderBy("tokens_estimate")))  # as many rows as there are distinct counts
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("tokens_estimate")))
    stats = upto.crossJoin(F.broadcast(total)).agg(F.max("chunks").alias("chunks"), F.max("sum").alias("sum"), F.max("most").alias("most"), at(F.greatest(F.floor(n * 0.95), F.lit(1))).alias("p95"), at(F.floor((n + 1) / 2)).alias("low"), at(F.floor(n / 2) + 1).alias("high"))
    docs = documents.agg(F.count("*").alias("documents"), F.sum("tokens_estimate").alias("total_tokens"), F.count_if(F.size("headings") == 0).alias("docs_without_headings"))
    alone = lambda df, c, edges, name: df.select(F.col(c).alias("src")).join(edges.select("src").distinct(), "src", "left_anti").agg(F.count("*").alias(name))
    every = docs.crossJoin(stats).crossJoin(alone(documents, "full_path", document_edges, "docs_without_related")).crossJoin(alone(chunks, "path", chunk_edges, "chunks_without_related"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return every.select("documents", zero(n).alias("chunks"), zero(F.col("total_tokens")).alias("total_tokens"), zero(F.round(F.col("sum") / n, 1)).alias("avg_chunk_tokens"), zero(F.round((F.col("low") + F.col("high")) / 2, 1)).alias("median_chunk_tokens"), zero(F.col("p95")).alias("p95_chunk_tokens"), zero(F.col("most")).alias("max_chunk_tokens"), "docs_without_headings", "docs_without_related", "chunks_without_related")
