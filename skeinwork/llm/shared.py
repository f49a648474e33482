"""Places and tables that outlive an executor, and Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import math
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textvec import mix

#: UTF-8 bytes that one vectorised step handles at a time (a longer text is handled alone).
SLICE_BYTES = 1 << 20
#: Bits of a Bloom filter, at most (32 MB).
BLOOM_BITS = 1 << 28
_made: list[tuple] = []


def shared_base(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.gettempdir() + "/skeinwork-shared"


def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before the interpreter
            return


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    if not _made:
        atexit.register(_clean)
    path = f"{shared_base(spark)}/skeinwork/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and rereads it: the lineage ends there, and the rows survive lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_order(df: DataFrame, *first: str) -> list[Column]:
    """A total order of rows up to rows that are equal in every column: the named columns, nulls last, then all others as JSON."""
    rest = [c for c in df.columns if c not in first]
    tail = [F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])))] if rest else []
    return [F.col(f"`{c}`").asc_nulls_last() for c in first] + tail


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes not to be a column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bloom(keys: DataFrame, n: int):
    """A column function that is true for every long in keys (key), and for few others: a Bloom filter of BLOOM_BITS at most. Beyond that size it lets more through, never less."""
    bits = min(BLOOM_BITS, 1 << max(10, math.ceil(math.log2(10 * max(n, 1)))))
    seeds = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]

    def words_of(batches):
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([mix(key ^ s) & np.uint64(bits - 1) for s in seeds]))
            word = (at >> np.uint64(6)).astype(np.int64)
            mask = np.uint64(1) << (at & np.uint64(63))
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else word
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(np.bitwise_or.reduceat(mask, first).view(np.int64) if len(word) else word)], names=["word", "mask"])

    table = np.zeros(bits >> 6, np.uint64)
    found = keys.mapInArrow(words_of, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def may_hold(col: pa.Array) -> pa.Array:
        key = col.to_numpy(zero_copy_only=False).view(np.uint64)
        hit = np.ones(len(key), bool)
        for s in seeds:
            at = mix(key ^ s) & np.uint64(bits - 1)
            hit &= (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return pa.array(hit)

    return may_hold


def without(docs: DataFrame, id_col: str, key: Column, decided: DataFrame) -> DataFrame:
    """docs without the rows whose (id, key) is gone in decided (doc_id, key, gone), and with one row only of those that are there but not gone. Null keys stay. decided should be cut: the optimizer then knows its size. Rows whose key isn't in a Bloom filter of its keys stay where they are; only the others are shuffled."""
    k, gid, gkey, gone, rank = (free_name(docs, x) for x in ("key_", "gone_id", "gone_key", "gone_", "rank_"))
    keys = decided.select(F.xxhash64("key").alias("key"))
    may_be = bloom(keys, keys.count())
    wide = docs.withColumn(k, key)
    named = decided.select(F.col("doc_id").alias(gid), F.col("key").alias(gkey), F.col("gone").alias(gone))
    met = F.col(k).isNotNull() & may_be(F.xxhash64(k))
    w = Window.partitionBy(k, f"`{id_col}`").orderBy(*row_order(docs))
    some = wide.where(met).join(named, [F.col(k) == F.col(gkey), F.col(f"`{id_col}`").eqNullSafe(F.col(gid))], "left")
    some = some.withColumn(rank, F.row_number().over(w)).where(F.col(gone).isNull() | (~F.col(gone) & (F.col(rank) == 1)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return wide.where(~met).select(*columns).unionByName(some.select(*columns))


def lean(run):
    """run, a function of batches (or of arrays, if its annotations say so), which at its end gives the memory that a Python worker has freed back to the system: workers outlive their tasks."""

    @wraps(run)
    def trimmed(batches):
        yield from run(batches)
        release()

    return trimmed


def release() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n+1 offsets into them; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, off - off[0]


def slices(col: pa.Array, budget: int = SLICE_BYTES):
    """Ranges (first, last) of rows whose bytes are about a budget."""
    _, off = raw_bytes(col)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + budget, "right")) - 1)
        yield i, min(j, len(col))
        i = j


def binary_array(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """A binary array over bytes and offsets; mask marks nulls."""
    valid = None if mask is None or not mask.any() else pa.py_buffer(np.packbits(~mask, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [valid, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
