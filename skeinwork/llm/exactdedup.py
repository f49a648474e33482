"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by SHA-256 digest. A batch is
reduced to one row per digest with partial aggregation, freed of known digests by
a sort-merge anti join in which the index isn't shuffled, and appended under the
batch's name. When all is appended, the batch is committed by a file with the batch's signature.

A batch that failed is run again under its name: what it had appended already counts as its own,
the rest is added, and its decisions are the same as if nothing had failed. A committed batch may be run again, too; it adds
nothing. Other rows under the name of a committed batch are refused. An index with more than
BUCKET_ROWS digests a bucket is rewritten with more buckets.

Defined results: a null text has no digest, is no duplicate and stays. Empty texts
are copies of each other. The copy with the least id stays (a null id comes last);
rows that agree in id and text count each, and one of them stays. Ids may repeat
over different texts. Extra columns take no part. An empty batch adds nothing.
"""

from __future__ import annotations

import hashlib
import json
import math
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, drop_path, new_path, without

#: Digests that a bucket holds before the index grows (some 50 bytes each).
BUCKET_ROWS = 1 << 23


class DigestIndex:
    """A digest index in a folder. buckets counts only for a new one (default: spark.sql.shuffle.partitions); an old one keeps its own until it grows."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        self.spark, self.path, self.id_type = spark, path, id_type
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        state = self._read("current")
        if state is None:
            state = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))}
            self._write("current", state)
        self._open(state["buckets"])

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read(self, name: str) -> dict | None:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]) if self.fs.exists(self._at(name)) else None

    def _write(self, name: str, value: dict) -> None:
        """A small file, there as a whole or not at all."""
        draft = f"{name}.draft"
        out = self.fs.create(self._at(draft), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self.fs.delete(self._at(name), False)
        self.fs.rename(self._at(draft), self._at(name))

    def _name(self, place: str) -> str:
        return "skeinwork_index_" + hashlib.sha256(place.encode()).hexdigest()[:16]

    def _open(self, buckets: int) -> None:
        place = f"{self.path}/buckets-{buckets}"
        self.buckets, self.name = buckets, self._name(place)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {self.id_type}, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def committed(self, batch: str) -> dict | None:
        """What is known of a committed batch: its signature, and how many digests the index had after it."""
        return self._read(f"batches/{quote(batch, safe='')}")

    def add(self, firsts: DataFrame, batch: str, signature: str) -> None:
        """Appends the digests (digest, keep_id) that the index doesn't have yet, and commits the batch."""
        new = firsts.repartition(self.buckets, "digest").join(self.table().hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id", F.lit(batch).alias("batch")).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        rows = self.table().count()
        self._write(f"batches/{quote(batch, safe='')}", {"signature": signature, "rows": rows})
        if rows > BUCKET_ROWS * self.buckets:
            self.grow(2 ** math.ceil(math.log2(2 * rows / BUCKET_ROWS)))

    def grow(self, buckets: int) -> None:
        """Rewrites the index with so many buckets. The old one counts until the new one is whole."""
        old, place = (self.table(), self.name, f"buckets-{self.buckets}"), f"buckets-{buckets}"
        if buckets == self.buckets:
            return
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(f'{self.path}/{place}')}")
        drop_path(self.spark, f"{self.path}/{place}")
        self._open(buckets)
        old[0].repartition(buckets, "digest").write.insertInto(self.name)
        self._write("current", {"buckets": buckets})
        self.spark.sql(f"DROP TABLE {old[1]}")
        drop_path(self.spark, f"{self.path}/{old[2]}")

    def close(self) -> None:
        """Takes the table out of the session's catalogue; the index stays in its folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def ingest(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds a batch to the index. Returns one row for each id and digest of the batch: (doc_id, digest, n, keep_id, is_new), n being its rows, is_new whether its row is the one that the index took from this batch. What is returned is stored and no longer depends on the index."""
    one = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.sha2(F.col(f"`{text_col}`"), 256)).alias("digest")).where("digest IS NOT NULL")
    counts = cut(one.groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "digests")
    size, total = counts.agg(F.count("*"), F.sum(F.xxhash64("digest", "doc_id", "n").cast("decimal(38,0)"))).first()
    signature, before = f"{size}:{total}", index.committed(batch)
    if before is None:
        index.add(counts.groupBy("digest").agg(F.min("doc_id").alias("keep_id")), batch, signature)
    elif before["signature"] != signature:
        raise ValueError(f"the batch {batch!r} is committed with other rows")
    met = counts.join(index.table(), "digest")
    return cut(met.select("doc_id", "digest", "n", "keep_id", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)).alias("is_new")), "digest-decisions")


def duplicates(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds a batch; returns a row (doc_id, keep_id, digest) for each row of it that goes."""
    found = ingest(docs, index, batch, id_col, text_col).withColumn("gone", F.col("n") - F.col("is_new").cast("int"))
    return found.where("gone > 0").select("doc_id", "keep_id", F.lower(F.hex("digest")).alias("digest"), F.explode(F.sequence(F.lit(1), F.col("gone"))).alias("k")).drop("k")


def deduplicated(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds a batch; returns the rows of it that stay, with all their columns."""
    found = ingest(docs, index, batch, id_col, text_col).withColumnRenamed("digest", "key")
    return without(docs, id_col, F.unhex(F.sha2(F.col(f"`{text_col}`"), 256)), found.where("NOT is_new OR n > 1").select("doc_id", "key", (~F.col("is_new")).alias("gone")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies among all documents, which come in two batches, the lower ids first: so the second meets an index that holds the first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    first = F.coalesce(F.col("doc_id") <= ((low or 0) + (high or 0)) // 2, F.lit(False))
    path = new_path(spark, "digest-index")
    index = DigestIndex(spark, path, docs.schema["doc_id"].dataType.simpleString())
    found = duplicates(docs.where(first), index, "lower ids").unionByName(duplicates(docs.where(~first), index, "higher ids"))
    index.close()
    drop_path(spark, path)
    return found


SQL = """
SELECT doc_id, keep_id, digest FROM (
  SELECT doc_id, sha256(text) AS digest, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k
  FROM documents WHERE text IS NOT NULL
  WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id NULLS LAST))
WHERE k > 1
"""
