"""Approximate nearest neighbours by an inverted file with product quantisation.

All rows that a condition holds for are queries (op1_ann: those whose id is divisible by 20), and all rows are searched; the
measure is cosine similarity. Vectors are normalised and
assigned to coarse centroids. What is left of a vector
is cut into parts, each coded by the nearest of 256 codewords. Both are fitted by Lloyd's rounds
over FIT rows a centroid, chosen by hash (over all rows of a smaller table); every row is indexed.
A query's tables hold the product of each of its parts with each codeword, and a
code's score is the sum of what its bytes look up. The best codes are reranked with
the vectors themselves; so are all whose score, with the most that quantisation may have taken
from it, reaches the k-th of those. So nothing is lost in the lists that are probed.

How many lists a query probes follows from the lists' sizes, centroids and spreads, all
counted over the whole table: taking the products with a list's vectors to be normal, a query
expects some of its neighbours in each list, and it probes the lists in order of
that yield until they hold TARGET of all. Well-clustered vectors probe few lists;
those without structure need about half of them, since no smaller part holds their neighbours.

Lists near each other form shards, of similar work. A query goes once to each shard in which it
probes a list, and the shards' best are merged. A list that is much longer than others is split
over shards.

Defined results: a vector that is null, has a null, NaN or infinite component, no
length, or another number of components than most vectors have (of equally many, the
larger number) has no neighbours and is none. A row isn't its own neighbour, but a
repeated row is. Neighbours found of equal similarity are ordered by id (null last), then by row.
Ids may repeat. If there are fewer than k others, all are found. Extra columns take no part.
Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import binary_array, cut, raw_bytes

K = 10
#: Share of the expected neighbours that the probed lists must hold.
TARGET = 0.96
#: Coarse centroids: the square root of the vectors, but no more than this, which bounds what is broadcast.
MAX_LISTS = 1 << 16
PARTS, CODES = 16, 256
COARSE_ROUNDS, CODE_ROUNDS = 6, 4
#: Rows for each centroid or codeword that the index is fitted to, or so: the bound of the sample.
FIT = 64
#: Bytes of vectors and codes of a shard, or so; there are no fewer shards than shuffle partitions.
SHARD_BYTES = 32 << 20
#: Values of a block of products with centroids.
BLOCK_VALUES = 1 << 21
#: Codes that are reranked first in each shard, for each neighbour wanted; they tell how far the others must be looked at.
RERANK = 6
#: A list with so many times the mean number of vectors is split.
LONG = 4
_BLOCK = 2048
#: More than the rounding of a product of two vectors of length 1 in single precision.
_SLACK = np.float32(1e-5)


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return raw_bytes(col)[0].view(np.float32).reshape(-1, d)


def _rows(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return binary_array(x.view(np.uint8).ravel(), np.arange(len(x) + 1) * (x.shape[1] * x.itemsize))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row; of equally near ones the first."""
    half = (centroids * centroids).sum(1) / 2
    step = max(1, BLOCK_VALUES // len(centroids))
    return np.concatenate([np.argmax(x[i : i + step] @ centroids.T - half, 1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def _tail(z: np.ndarray) -> np.ndarray:
    """The chance that a normal variable exceeds z, to about 1e-7."""
    a = np.abs(z) / np.float32(math.sqrt(2))
    t = 1 / (1 + np.float32(0.3275911) * a)
    p = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-a * a) / 2
    return np.where(z > 0, p, 1 - p)


def prepared(vectors: DataFrame, id_col: str, vec_col: str, asks: Column) -> tuple[DataFrame, int]:
    """(uid, vec_id, v, asks) of the usable vectors, v being the normalised components as bytes, and their number of components."""
    own = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"), F.coalesce(asks, F.lit(False)).alias("asks"))
    sizes = own.where("size(x) > 0").groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes.d if sizes else 1

    def unit(batches):
        for batch in batches:
            usable = np.asarray(batch.column(1).is_valid()) & (batch.column(1).value_lengths().fill_null(0).to_numpy() == d)
            some = batch.filter(pa.array(usable))
            x = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            largest = np.abs(x).max(1) if len(x) else np.zeros(0)
            good = np.isfinite(largest) & (largest > 0)
            x = x[good] / largest[good][:, None]
            x /= np.sqrt((x * x).sum(1))[:, None]
            yield pa.RecordBatch.from_arrays([some.column(0).filter(pa.array(good)), _rows(x.astype(np.float32)), some.column(2).filter(pa.array(good))], names=["vec_id", "v", "asks"])

    rows = own.mapInArrow(unit, f"vec_id {own.schema['vec_id'].dataType.simpleString()}, v binary, asks boolean")
    return cut(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors"), d


def _summed(parts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds up rows (key, n, s) by key, s holding width doubles; keys, counts and sums go to the driver, as many as there are centroids."""

    def add(batches):
        keys, n, s = [], [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            n.append(batch.column(1).to_numpy())
            s.append(raw_bytes(batch.column(2))[0].view(np.float64).reshape(-1, width))
        if keys:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros((len(k), width))
            np.add.at(total, at, np.concatenate(s))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.bincount(at, np.concatenate(n), len(k)).astype(np.int64)), _rows(total)], names=["key", "n", "s"])

    found = parts.repartition("key").mapInArrow(add, "key bigint, n bigint, s binary").orderBy("key").toArrow().combine_chunks()
    s = found["s"].combine_chunks() if found.num_rows else pa.array([], pa.binary())
    return found["key"].to_numpy(), found["n"].to_numpy(), raw_bytes(s)[0].view(np.float64).reshape(-1, width)


def _groups(key: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(key, kind="stable")
    k, first = np.unique(key[order], return_index=True)
    sums = np.add.reduceat(x[order].astype(np.float64), first, axis=0) if len(k) else np.zeros((0, x.shape[1]))
    return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(np.diff(np.append(first, len(key))).astype(np.int64)), _rows(sums)], names=["key", "n", "s"])


def _all(batches, d: int):
    """Batches of a task's vectors, joined up to a bounded size."""
    kept, n = [], 0
    for batch in batches:
        kept.append(_matrix(batch.column(0), d))
        n += len(batch)
        if n >= 1 << 16:
            yield np.concatenate(kept)
            kept, n = [], 0
    if n:
        yield np.concatenate(kept)


class Index:
    """Centroids, the lists' sizes and spreads, codewords, and the lists' shards. A list that is split counts as several with one centroid: list k has the numbers from first[k] on, split[k] of them."""

    def __init__(self, centroids: np.ndarray, sizes: np.ndarray, spread: np.ndarray, words: np.ndarray, shards: int):
        self.centroids, self.words = centroids, words
        usual = max(1.0, sizes.sum() / max(1, len(sizes)))
        self.split = np.maximum(1, np.ceil(sizes / (LONG * usual)).astype(np.int64))
        self.first = np.cumsum(self.split) - self.split
        self.sizes, self.spread = sizes, np.maximum(spread, 1e-6).astype(np.float32)
        self.parent = np.repeat(np.arange(len(sizes)), self.split)
        self.shard = np.zeros(len(self.parent), np.int64)
        todo, name = [(np.arange(len(self.parent)), shards)], 0
        weight = (sizes / self.split)[self.parent] + 1
        while todo:
            at, k = todo.pop()
            if k <= 1 or len(at) <= 1:
                self.shard[at] = name
                name += 1
                continue
            c = centroids[self.parent[at]]
            axis = np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0] if len(at) > 1 else c[0]
            order = at[np.argsort(c @ axis, kind="stable")]
            share = np.cumsum(weight[order]) / weight[order].sum()
            m = min(len(at) - 1, max(1, int(np.searchsorted(share, (k // 2) / k)) + 1))
            todo += [(order[:m], k // 2), (order[m:], k - k // 2)]
        self.shards = max(1, name)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = _parts(x - self.centroids[lists], self.words.shape[2])
        return np.stack([nearest(rest[:, j], w) for j, w in enumerate(self.words)], 1).astype(np.uint8)

    def yields(self, product: np.ndarray, k: int) -> np.ndarray:
        """How many of its k + 1 nearest (itself among them) each query expects in each list."""
        low, high = np.full(len(product), -1.5, np.float32), np.full(len(product), 1.5, np.float32)
        for _ in range(12):
            at = (low + high) / 2
            more = (self.sizes * _tail((at[:, None] - product) / self.spread)).sum(1) > k + 1
            low, high = np.where(more, at, low), np.where(more, high, at)
        return self.sizes * _tail((low[:, None] - product) / self.spread)

    def probed(self, x: np.ndarray, k: int, target: float) -> np.ndarray:
        """(queries, lists): which lists each query probes; the list with the nearest centroid always."""
        product = (x @ self.centroids.T).astype(np.float32)
        found = self.yields(product, k)
        order = np.argsort(-found, 1, kind="stable")
        held = np.cumsum(np.take_along_axis(found, order, 1), 1)
        take = np.ones(held.shape, bool)
        take[:, 1:] = held[:, :-1] < target * held[:, -1:]
        out = np.zeros(held.shape, bool)
        np.put_along_axis(out, order, take, 1)
        out[np.arange(len(x)), nearest(x, self.centroids)] = True
        return out & (self.sizes > 0)


def _parts(x: np.ndarray, width: int) -> np.ndarray:
    """(rows, parts, width), filled up with zeros."""
    m = -(-x.shape[1] // width)
    return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)


def build(rows: DataFrame, d: int, shards: int) -> Index | None:
    """Fits an index to rows (uid, vec_id, v): centroids and codewords to FIT rows for each, sizes and spreads of lists to all. It has shards shards at least."""
    spark = rows.sparkSession
    n = rows.count()
    if not n:
        return None
    lists = max(1, min(MAX_LISTS, round(math.sqrt(n))))
    shards = max(shards, math.ceil(n * (4 * d + 64) / SHARD_BYTES))
    every = n // (FIT * max(lists, CODES))
    some = rows if every <= 1 else cut(rows.where(F.pmod(F.xxhash64("v", "uid"), F.lit(every)) == 0).select("v"), "fitted")
    start = rows.orderBy(F.xxhash64("v", "uid"), "uid").limit(2 * max(lists, CODES)).select("v").toArrow()["v"].combine_chunks()
    seeds = _matrix(start, d)
    seeds = seeds[np.sort(np.unique(seeds, axis=0, return_index=True)[1])]
    centroids = seeds[:lists].copy()

    for _ in range(COARSE_ROUNDS):
        now = spark.sparkContext.broadcast(centroids)

        def assign(batches, now=now):
            for x in _all(batches, d):
                yield _groups(nearest(x, now.value), x)

        key, count, total = _summed(some.select("v").mapInArrow(assign, "key bigint, n bigint, s binary"), d)
        centroids = centroids.copy()
        centroids[key] = (total / count[:, None]).astype(np.float32)

    width = -(-d // min(PARTS, d))
    rest = _parts(seeds - centroids[nearest(seeds, centroids)], width)
    words = np.ascontiguousarray(rest[:CODES].transpose(1, 0, 2))
    parts, codes = words.shape[:2]
    fixed = spark.sparkContext.broadcast(centroids)
    for _ in range(CODE_ROUNDS):
        now = spark.sparkContext.broadcast(words)

        def assign_parts(batches, now=now):
            for x in _all(batches, d):
                rest = _parts(x - fixed.value[nearest(x, fixed.value)], width)
                for j in range(parts):
                    yield _groups(nearest(rest[:, j], now.value[j]) + j * codes, rest[:, j])

        key, count, total = _summed(some.select("v").mapInArrow(assign_parts, "key bigint, n bigint, s binary"), width)
        words = words.copy()
        words.reshape(-1, width)[key] = (total / count[:, None]).astype(np.float32)

    def spread(batches):
        for x in _all(batches, d):
            k = nearest(x, fixed.value)
            yield _groups(k, ((x - fixed.value[k]) ** 2).sum(1, keepdims=True))

    key, count, total = _summed(rows.select("v").mapInArrow(spread, "key bigint, n bigint, s binary"), 1)
    sizes, square = np.zeros(len(centroids)), np.zeros(len(centroids))
    sizes[key], square[key] = count, total[:, 0] / count
    return Index(centroids, sizes, np.sqrt(square / d), words, shards)


def _best(index: Index, d: int, k: int):
    """A task's rows (shard, kind, uid, vec_id, list, code, v), members (kind 0) before queries (kind 1, list holding the probed lists as bytes), to (uid, found), each query's best in the shard."""

    def joined(members):
        """A shard's members, sorted by list: vectors, codes, ids, rows, lists, and each member's place among them."""
        lists = np.concatenate([m[0] for m in members])
        order = np.argsort(lists, kind="stable")
        code, v, uid = (np.concatenate([m[j] for m in members])[order] for j in (1, 2, 3))
        own, at_own = np.unique(lists[order], return_inverse=True)
        ids = pa.concat_arrays([m[4] for m in members]).take(pa.array(order))
        place = np.empty(len(v), np.int64)
        place[pc.sort_indices(pa.table({"id": ids, "uid": uid}), sort_keys=[("id", "ascending"), ("uid", "ascending")]).to_numpy()] = np.arange(len(v))
        rest = _parts(v - index.centroids[index.parent[own]][at_own], index.words.shape[2])
        lost = np.stack([np.sqrt(((rest[:, j] - w[code[:, j]]) ** 2).sum(1)) for j, w in enumerate(index.words)])
        return v, code, ids, uid, own, at_own, place, lost

    def search(v, code, ids, uid, own, at_own, place, lost, probes, x, who):
        table = np.einsum("qjw,jcw->jcq", _parts(x, index.words.shape[2]), index.words, optimize=True)
        # products with centroids differ between the lists of a shard, not between their vectors
        base = index.centroids[index.parent[own]] @ x.T
        wanted = np.array([np.isin(own, np.frombuffer(p, np.int32)) for p in probes]).T
        score = np.where(wanted, base, -np.inf).astype(np.float32)[at_own]
        for j in range(code.shape[1]):
            score += table[j][code[:, j]]
        score = np.ascontiguousarray(score.T)
        short = min(len(v), RERANK * k + 1)
        pick = np.argpartition(-score, short - 1, 1)[:, :short] if short < len(v) else np.broadcast_to(np.arange(len(v)), score.shape)
        some = np.isfinite(np.take_along_axis(score, pick, 1)) & (uid[pick] != who[:, None])
        exact = np.where(some, np.einsum("qd,qrd->qr", x, v[pick], optimize=True), -np.inf)
        bound = -np.partition(-exact, min(k, short) - 1, 1)[:, min(k, short) - 1]
        if short < len(v):
            # no part's product with what was lost exceeds the product of their lengths
            score += np.sqrt((_parts(x, index.words.shape[2]) ** 2).sum(2)) @ lost
            more = np.isfinite(score) & (score >= bound[:, None] - _SLACK) & (uid != who[:, None])
            exact = np.where(more, x @ v.T, -np.inf)
            bound = -np.partition(-exact, k - 1, 1)[:, k - 1]
            pick = np.broadcast_to(np.arange(len(v)), exact.shape)
        q, r = np.nonzero(np.isfinite(exact) & (exact >= bound[:, None] - _SLACK))
        at = pick[q, r]
        # summed in one order, whatever the block, so that equal vectors are equally near; ties are settled by id, then row
        near = np.concatenate([(x[q[a : a + (1 << 16)]] * v[at[a : a + (1 << 16)]]).sum(1) for a in range(0, len(q), 1 << 16)]) if len(q) else np.zeros(0, np.float32)
        order = np.lexsort((place[at], -near, q))
        first = np.searchsorted(q, q)  # q is sorted, before and after
        order = order[np.arange(len(q)) - first < k]
        q, at, near = q[order], at[order], near[order]
        return pa.RecordBatch.from_arrays([pa.array(who[q]), ids.take(pa.array(at)), pa.array(uid[at]), pa.array(near.astype(np.float64))], names=["query", "neighbour_id", "neighbour", "similarity"])

    def run(batches):
        shard, members, index_of = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            mark = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(mark[1:] != mark[:-1]) + 1, [len(mark)]])
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(a, b - a)
                if mark[a] // 2 != shard:
                    shard, members, index_of = mark[a] // 2, [], None
                x, uid = _matrix(part.column(6), d), part.column(2).to_numpy()
                if mark[a] % 2 == 0:
                    members.append((raw_bytes(part.column(4))[0].view(np.int32), raw_bytes(part.column(5))[0].reshape(len(part), -1), x, uid, part.column(3)))
                elif members:
                    index_of = index_of or joined(members)
                    probes = part.column(4).to_pylist()
                    step = min(256, max(1, (1 << 23) // len(index_of[0])))
                    for i in range(0, len(part), step):
                        yield search(*index_of, probes[i : i + step], x[i : i + step], uid[i : i + step])

    return run


def neighbours(vectors: DataFrame, k: int = K, target: float = TARGET, id_col: str = "vec_id", vec_col: str = "embedding", asks: Column | None = None) -> DataFrame:
    """The k nearest other rows of every row that asks (of every row, by default): (vec_id, neighbour_id, rank, similarity), rank from 1."""
    spark = vectors.sparkSession
    rows, d = prepared(vectors, id_col, vec_col, F.lit(True) if asks is None else asks)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    index = build(rows, d, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if index is None:
        return spark.createDataFrame([], f"vec_id {id_type}, neighbour_id {id_type}, rank int, similarity double")
    shared = spark.sparkContext.broadcast(index)
    shape = f"shard bigint, kind int, uid bigint, vec_id {id_type}, list binary, code binary, v binary"

    def send(batches):
        ix = shared.value
        for batch in batches:
            for i in range(0, len(batch), _BLOCK):
                some = batch.slice(i, _BLOCK)
                x, uid = _matrix(some.column(2), d), some.column(0).to_numpy()
                base = nearest(x, ix.centroids)
                own = ix.first[base] + uid % ix.split[base]
                yield pa.RecordBatch.from_arrays([pa.array(ix.shard[own]), pa.array(np.zeros(len(x), np.int32)), some.column(0), some.column(1), _rows(own.astype(np.int32)[:, None]), _rows(ix.codes(x, base)), some.column(2)], names=["shard", "kind", "uid", "vec_id", "list", "code", "v"])
                asking = np.flatnonzero(some.column(3).to_numpy(zero_copy_only=False))
                step = max(1, BLOCK_VALUES // len(ix.centroids))
                for a in range(0, len(asking), step):
                    now = asking[a : a + step]
                    q, lists = np.nonzero(ix.probed(x[now], k, target)[:, ix.parent])
                    key = q * ix.shards + ix.shard[lists]
                    order = np.argsort(key, kind="stable")
                    pairs, first = np.unique(key[order], return_index=True)
                    bounds = np.append(first, len(key)) * 4
                    row = pa.array(now[pairs // ix.shards])
                    yield pa.RecordBatch.from_arrays([pa.array(pairs % ix.shards), pa.array(np.ones(len(pairs), np.int32)), some.column(0).take(row), pa.nulls(len(pairs), some.schema.field(1).type), binary_array(lists[order].astype(np.int32).view(np.uint8), bounds), pa.nulls(len(pairs), pa.binary()), some.column(2).take(row)], names=["shard", "kind", "uid", "vec_id", "list", "code", "v"])

    sent = rows.select("uid", "vec_id", "v", "asks").mapInArrow(send, shape)
    met = sent.repartitionById(index.shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "kind")
    found = met.mapInArrow(lambda batches: _best(shared.value, d, k)(batches), f"query bigint, neighbour_id {id_type}, neighbour bigint, similarity double")
    item = F.struct((-F.col("similarity")).alias("far"), F.col("neighbour_id").isNull().alias("last"), F.col("neighbour_id").alias("id"), F.col("neighbour").alias("row"))
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(item)), 1, k).alias("best"))
    wide = best.select("query", F.posexplode("best").alias("place", "x"))
    names = rows.select(F.col("uid").alias("query"), "vec_id")
    return wide.join(names, "query").select("vec_id", F.col("x.id").alias("neighbour_id"), (F.col("place") + 1).alias("rank"), (-F.col("x.far")).alias("similarity"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours, among all vectors, of those whose id is divisible by 20."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), asks=F.col("vec_id") % 20 == 0)
