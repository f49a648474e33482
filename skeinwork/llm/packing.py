"""Best-fit packing of documents into bins of fixed capacity, bulk-synchronously.

A document is as long as it has words; one longer than the capacity is cut into full
pieces, which fill bins of their own, and a rest. The rests go in rounds. A round
sorts rests and gaps together by range, longest first and gaps before rests of the
same size, and sweeps: each rest takes the smallest gap that is free and large enough,
which is the last one before it that no longer rest took, like a closing bracket its
opening one. Ranges are swept apart; what is left of each is a count of closing and
opening brackets, matched between ranges by rank. A gap that holds several of the longest
rest offers as many places. Then gaps shrink, and the rests that are longer than
every gap open bins, by rank: as many as their words fill, and all longer than half a bin.
The next round begins, until all is placed. Each round's state is written to the shared folder.

Defined results: texts that are null, empty or blank have length 0 and no bin. Equal
lengths are ordered by id (nulls last), then by a hash of the text. Repeated rows are
packed each. Extra columns take no part. The packing doesn't depend on how rows are
spread over tasks. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, raw_bytes, slices
from .textvec import beyond_ascii, runs

#: Words that a bin holds.
CAPACITY = 2048
_PIECE_BITS = 23
IS_WORD = np.ones(256, bool)
IS_WORD[[*range(9, 14), 32]] = False


def word_count(text: Column) -> Column:
    """Runs of characters that aren't white space (of ASCII), cut so that each character of a script without spaces is a word."""

    @F.arrow_udf("bigint")
    def count(col: pa.Array) -> pa.Array:
        out = []
        for i, j in slices(col):
            data, off = raw_bytes(col[i:j])
            start, _ = runs(IS_WORD[data], np.union1d(off, beyond_ascii(data)[1]))
            out.append(np.diff(np.searchsorted(start, off)))
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))

    return count(text)


def _sweep(batches):
    """Rows (size, kind, id) of a range in order, kind 0 a gap, 1 a rest. Returns matched rests with their gap, and the others with their rank: rests from the front, gaps from the back."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    size, kind, ident = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in range(3))
    depth = np.cumsum(1 - 2 * kind.astype(np.int64))
    level = depth + kind
    order = np.argsort(level, kind="stable")
    a, b = order[:-1], order[1:]
    hit = (level[a] == level[b]) & (kind[a] == 0) & (kind[b] == 1)
    gap = np.full(len(size), -1)
    gap[b[hit]] = ident[a[hit]]
    free = np.ones(len(size), bool)
    free[a[hit]] = free[b[hit]] = False
    rank = np.full(len(size), -1)
    d, g = np.flatnonzero(free & (kind == 1)), np.flatnonzero(free & (kind == 0))
    rank[d], rank[g] = np.arange(len(d)), np.arange(len(g))[::-1]
    out = (kind == 1) | free
    n = int(out.sum())
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, TaskContext.get().partitionId())), *(pa.array(x[out]) for x in (size, kind.astype(np.int32), ident)), pa.array(gap[out], mask=gap[out] < 0), pa.array(rank[out], mask=rank[out] < 0)], names=["part", "size", "kind", "id", "bin", "rank"])


def _between(counts: list) -> tuple[list, list]:
    """Matches what the ranges have left. counts: (part, rests, gaps) in order. Returns segments (part, first rank, last rank + 1, gaps' part, shift of the rank), and for each part (part, first rank without gap, rests without gap before it)."""
    stack, segments, open_ = [], [], []
    before = 0
    for part, rests, gaps in counts:
        done = 0
        while done < rests and stack:
            at, used, left = stack.pop()
            n = min(rests - done, left)
            segments.append((part, done, done + n, at, used - done))
            done += n
            if left > n:
                stack.append((at, used + n, left - n))
        open_.append((part, done, before))
        before += rests - done
        if gaps:
            stack.append((part, 0, gaps))
    return segments, open_


def pack_items(items: DataFrame, capacity: int) -> DataFrame:
    """items (uid, size), sizes from 1 to capacity - 1, uid in the order of their sizes, longest first, to (uid, bin, round); a bin has the uid of the item that opened it."""
    spark = items.sparkSession
    left, bins, placed, rounds = items.select("uid", "size"), None, [], 0
    stats = left.agg(F.max("size").alias("most"), F.min("size").alias("least"), F.count("*").alias("n")).first()
    while stats.n:
        rows = left.select("size", F.lit(1).cast("byte").alias("kind"), F.col("uid").alias("id"))
        if bins is not None:
            bins = bins.where(F.col("gap") >= stats.least)
            some = max(1, bins.count())
            places = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / stats.most), F.lit(2 * math.ceil(stats.n / some))).cast("int"))
            rows = rows.unionByName(bins.select(F.col("gap").alias("size"), F.lit(0).cast("byte").alias("kind"), F.col("bin").alias("id"), F.explode(F.array_repeat(F.lit(0), places)).alias("k")).drop("k"))
        order = [F.col("size").desc(), F.col("kind"), F.col("id")]
        swept = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sweep, "part bigint, size bigint, kind int, id bigint, bin bigint, rank bigint"), "swept")
        counts = swept.where("rank IS NOT NULL").groupBy("part").agg(F.count_if(F.col("kind") == 1).alias("rests"), F.count_if(F.col("kind") == 0).alias("gaps")).orderBy("part").collect()  # a row for each task
        segments, open_ = _between([tuple(r) for r in counts])
        rests, gaps = swept.where("kind = 1"), swept.where("kind = 0").select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), F.col("id").alias("gap_bin"))
        free = rests.where("rank IS NOT NULL").drop("bin")
        first = spark.createDataFrame(open_ or [(-1, 0, 0)], "part bigint, first bigint, before bigint")
        none = free.join(first, "part").where("rank >= first").select("id", "size", F.lit(None).cast("bigint").alias("bin"), (F.col("rank") - F.col("first") + F.col("before")).alias("turn"))
        done = rests.where("rank IS NULL").select("id", "size", "bin", F.lit(None).cast("bigint").alias("turn"))
        if segments:
            segs = spark.createDataFrame(segments, "part bigint, a bigint, z bigint, gap_part bigint, shift bigint")
            across = free.join(segs, "part").where("rank >= a AND rank < z").withColumn("gap_rank", F.col("rank") + F.col("shift")).join(gaps, ["gap_part", "gap_rank"])
            done = done.unionByName(across.select("id", "size", F.col("gap_bin").alias("bin"), F.lit(None).cast("bigint").alias("turn")))
        now = cut(done.unionByName(none), "round")
        waiting = F.col("bin").isNull()
        widest = 0
        if bins is not None:
            shrunk = bins.unionByName(now.where(~waiting).select("bin", (-F.col("size")).alias("gap"))).groupBy("bin").agg(F.sum("gap").alias("gap"))
            bins = cut(shrunk.where("gap > 0"), "gaps")
            widest = bins.agg(F.max("gap")).first()[0] or 0
        big = waiting & (F.col("size") > widest)
        total = now.where(big).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count_if(F.col("size") * 2 > capacity).alias("large")).first()
        opened = max(total.large, math.ceil(total.size / capacity))
        opens = waiting & (F.col("turn") < opened)
        placed.append(now.where(~waiting | opens).select(F.col("id").alias("uid"), F.coalesce("bin", "id").alias("bin"), F.lit(rounds).alias("round")))
        new = now.where(opens).select(F.col("id").alias("bin"), (F.lit(capacity) - F.col("size")).alias("gap"))
        bins = new if bins is None else bins.unionByName(new)
        left = now.where(waiting & (F.col("turn") >= opened)).select(F.col("id").alias("uid"), "size")
        stats = left.agg(F.max("size").alias("most"), F.min("size").alias("least"), F.count("*").alias("n")).first()
        rounds += 1
    out = placed[0] if placed else items.select("uid", F.col("uid").alias("bin"), F.lit(0).alias("round"))
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None) -> DataFrame:
    """Rows (bin_id, doc_id, piece, start, length, place): a piece of a document, its first word in it, its words, and where it begins in its bin. length gives a document's length, if it isn't to be its words."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (word_count(F.col(f"`{text_col}`")) if length is None else F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0))).alias("words"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"))
    own = cut(own.withColumn("size", F.col("words") % capacity), "lengths")
    order = [F.col("size").desc(), F.col("doc_id").asc_nulls_last(), F.col("key"), F.col("words")]
    rows = cut(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()), "items")
    rows = rows.withColumn("part", F.shiftright("m", 33))
    before, offsets = 0, []
    for r in rows.groupBy("part").count().orderBy("part").collect():  # a row for each task
        offsets.append((r["part"], before))
        before += r["count"]
    at = spark.createDataFrame(offsets or [(-1, 0)], "part bigint, before bigint")
    rows = rows.join(at, "part").select((F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("uid"), "doc_id", "words", "size")
    packed = pack_items(rows.where("size > 0"), capacity)
    full = (F.col("words") - F.col("size")) / capacity
    rest = rows.where("size > 0").join(packed, "uid").select(F.shiftleft("bin", _PIECE_BITS).alias("bin_id"), "doc_id", full.cast("int").alias("piece"), (F.col("words") - F.col("size")).alias("start"), F.col("size").alias("length"), "round", "uid")
    w = Window.partitionBy("bin_id").orderBy("round", "uid")
    rest = rest.withColumn("place", F.sum("length").over(w) - F.col("length")).drop("round", "uid")
    whole = rows.where(F.col("words") >= capacity).withColumn("piece", F.explode(F.sequence(F.lit(0), full.cast("int") - 1)))
    whole = whole.select((F.shiftleft("uid", _PIECE_BITS) + 1 + F.col("piece")).alias("bin_id"), "doc_id", "piece", (F.col("piece") * F.lit(capacity).cast("long")).alias("start"), F.lit(capacity).cast("long").alias("length"), F.lit(0).cast("long").alias("place"))
    none = rows.where("words = 0").select(F.lit(None).cast("bigint").alias("bin_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("place"))
    return rest.unionByName(whole).unionByName(none)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
