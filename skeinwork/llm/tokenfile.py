"""Token ids in frequency-ranked, byte-aligned variable-length coding.

Ids are counted over the whole table and ranked, the most frequent first, so that
frequent ids have small ranks. A rank takes one, two, three or four bytes. The lengths
stand apart from the bytes: four of them, two bits each, in a control byte. Decoding
looks up each control byte in a table of the four lengths, and gathers the bytes.

Defined results: null ids have null control and data bytes, an empty list has empty
ones. Equally frequent ids are ranked by id. Rows are coded one by one, so repeated
rows get equal bytes. Extra columns take no part. An id without a rank (ranks of
another table) raises ValueError. An empty table gives no ranks and no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .shared import binary_array, cut, raw_bytes, slices

#: The lengths that each control byte stands for, and their sum.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def code(ranks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, their bounds, data bytes and their bounds of many lists of ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    n = np.diff(bounds)
    control_bounds = np.concatenate([[0], np.cumsum((n + 3) // 4)])
    # each list begins a control byte of its own; places without an id stand for one byte that isn't there
    slot = np.arange(len(ranks)) + np.repeat(control_bounds[:-1] * 4 - bounds[:-1], n)
    bits = np.zeros(int(control_bounds[-1]) * 4, np.uint8)
    bits[slot] = size - 1
    four = bits.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    keep = np.arange(4) < size[:, None]
    data = ranks.view(np.uint8).reshape(-1, 4)[keep]
    return control.astype(np.uint8), control_bounds, data, np.concatenate([[0], np.cumsum(size)])[bounds]


def decode(control: np.ndarray, control_bounds: np.ndarray, n: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The ranks of many lists of n ids each."""
    slots = LENGTHS[control].ravel()
    bounds = np.concatenate([[0], np.cumsum(n)])
    slot = np.arange(bounds[-1]) + np.repeat(control_bounds[:-1] * 4 - bounds[:-1], n)
    size = slots[slot]
    first = np.cumsum(size) - size
    wide = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
    out = wide[first]
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= wide[first[more] + k] << np.uint32(8 * k)
    return out


def rank_table(rows: DataFrame, kind: type = np.uint16, ids_col: str = "ids") -> DataFrame:
    """rows with packed ids to (id, n, rank): how often each id occurs in them, and its rank from 0."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for i, j in slices(batch.column(0)):
                found = np.bincount(np.frombuffer(raw_bytes(batch.column(0)[i:j])[0].tobytes(), kind))
                if len(found) > len(total):
                    found[: len(total)] += total
                    total = found
                else:
                    total[: len(found)] += found
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["id", "n"])

    counts = rows.select(F.col(f"`{ids_col}`").alias("ids")).mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    # as many rows as a vocabulary has, so one task can rank them
    return counts.repartition(1).sortWithinPartitions(F.col("n").desc(), "id").withColumn("rank", F.monotonically_increasing_id())


def _order(ranks: DataFrame) -> np.ndarray:
    """Ids by rank; -1 where the table lacks a rank."""
    found = ranks.select("id", "rank").toArrow()
    rank = found["rank"].to_numpy()
    out = np.full(int(rank.max()) + 1 if len(rank) else 0, -1, np.int64)
    out[rank] = found["id"].to_numpy()
    return out


def write(rows: DataFrame, ranks: DataFrame, kind: type = np.uint16, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """rows with packed ids to (doc_id, n_tokens, control, data)."""
    order = _order(ranks)
    rank = np.full(int(order.max()) + 1 if len(order) else 1, -1, np.int64)
    rank[order[order >= 0]] = np.flatnonzero(order >= 0)
    shared = rows.sparkSession.sparkContext.broadcast(rank)  # no longer than a vocabulary
    own = rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(1)):
                col = batch.column(1)[i:j]
                data, off = raw_bytes(col)
                ids = np.frombuffer(data.tobytes(), kind).astype(np.int64)
                bounds, none = off // np.dtype(kind).itemsize, np.asarray(col.is_null())
                mine = shared.value[np.minimum(ids, len(shared.value) - 1)]
                if len(ids) and (ids.max() >= len(shared.value) or mine.min() < 0):
                    raise ValueError("an id has no rank: the ranks aren't those of this table")
                control, cb, out, ob = code(mine, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(bounds), mask=none), binary_array(control, cb, none), binary_array(out, ob, none)], names=["doc_id", "n_tokens", "control", "data"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, control binary, data binary")


def read(coded: DataFrame, ranks: DataFrame, kind: type = np.uint16) -> DataFrame:
    """(doc_id, n_tokens, control, data) to (doc_id, packed ids)."""
    shared = coded.sparkSession.sparkContext.broadcast(_order(ranks))

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(3)):
                none = np.asarray(batch.column(1)[i:j].is_null())
                n = np.where(none, 0, batch.column(1)[i:j].fill_null(0).to_numpy())
                control, cb = raw_bytes(batch.column(2)[i:j])
                found = shared.value[decode(control, cb, n, raw_bytes(batch.column(3)[i:j])[0])].astype(kind)
                bounds = np.concatenate([[0], np.cumsum(n)]) * np.dtype(kind).itemsize
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], binary_array(found.view(np.uint8), bounds, none)], names=["doc_id", "ids"])

    return coded.select("doc_id", "n_tokens", "control", "data").mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, ids binary")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = bpe.vocabulary(spark)
    kind = bpe.loaded(shared).kind
    rows = cut(bpe.encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared), "token-ids")
    return write(rows, cut(rank_table(rows, kind), "ranks"), kind)
