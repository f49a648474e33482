"""The corpus pipeline: rejects documents of no known language, drops exact copies, leaves one document of each group of near copies, and packs the rest into bins.

Defined results: null, empty and letterless texts have no known language and go, if any document is labelled; else no
document does. Of copies, the document with the least id stays (null last); rows that agree in id and text count as
copies. The rows that are left, however long, are in bins by their words; without words they have no bin. Columns beside
those of documents stay up to the packing. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import exactdedup, langid, packing, simhash
from skeinwork.llm.shared import cut, new_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which most letters are in a known language."""
    return langid.known_language(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    index = exactdedup.DigestIndex(spark, new_path(spark, "digest-index"), docs.schema["doc_id"].dataType.simpleString())
    kept = exactdedup.deduplicated(docs, index, "documents")
    index.close()
    return kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the documents that are left."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("best-fit packing", packed)]
#: SQL can express neither the language model nor the packing; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each stage written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
