"""The tables of the queries: documents of the given tables, and Markdown that is derived from them, since their own text has neither headings nor references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as T
from ..operators import chunking

#: SQL of the derived text, for Spark and DuckDB alike; n stands for the number of documents.
CONTENT = r"""concat(
  '# Note ', cast(doc_id as string), chr(10), chr(10),
  case when doc_id % 5 = 0 then concat('Overview', chr(10), '--------', chr(10), chr(10)) else '' end,
  replace(text, chr(10), concat(chr(10), chr(10))), chr(10), chr(10),
  '## ', cast(doc_id % 9 + 1 as string), '.', cast(doc_id as string), ' Links', chr(10), chr(10),
  'See `note_', cast((doc_id * 13 + 7) % n as string), '.md`, REQ-', cast(100 + doc_id % 50 as string),
  ', section ', cast((doc_id * 7) % 9 + 1 as string), '.', cast((doc_id * 7) % n as string),
  ', `client_', cast((doc_id * 3) % n as string), '` and `Note ', cast((doc_id * 11) % n as string), '`.', chr(10), chr(10),
  case when doc_id % 7 = 0 then concat('```python', chr(10), '# not a heading', chr(10), chr(10), 'client_', cast(doc_id as string), '()', chr(10), '```', chr(10), chr(10)) else '' end,
  case when doc_id % 6 = 0 then concat('| k | v |', chr(10), '| --- | --- |', chr(10), '| a | ', cast(doc_id as string), ' |', chr(10), chr(10)) else '' end,
  case when doc_id % 11 = 0 then concat('## License', chr(10), chr(10), 'Copyright notice: license, trademark, foundation, donate, archive.', chr(10), chr(10)) else '' end,
  '### client_', cast(doc_id as string), chr(10), chr(10), '![fig](img_', cast(doc_id % 3 as string), '.png) end of note.')"""
SOURCE = "concat('note_', cast(doc_id as string), case when doc_id % 4 = 3 then '.txt' else '.md' end)"
FULL = "concat('docs/full/note_', cast(doc_id as string), '.md')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, spread over all cores if it lies in fewer splits than there are cores. Large tables have more, and aren't shuffled."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, original_source, full_path, content) for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.agg(F.count("*").alias("n"))  # one row
    return docs.crossJoin(F.broadcast(n)).selectExpr("doc_id", f"{SOURCE} AS original_source", f"{FULL} AS full_path", f"{CONTENT} AS content")


def note_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """notes as documents with title and headings."""
    d = notes(spark, sf_dir).withColumn("headings", M.headings(F.col("content")))
    return d.withColumn("title", T.heading_text(F.element_at("headings", 1))).withColumn("tokens_estimate", T.estimate_tokens(F.col("content"))).withColumn("format", F.lit("markdown"))


def note_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(note_documents(spark, sf_dir))
