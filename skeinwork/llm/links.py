"""Pairs of similar texts that are in no common group yet: an exact join of sets by prefixes.

A text is the set of its shingles, in one order for all texts, rare ones first. Two
texts of Jaccard similarity t share a shingle among the first of both, a text's first
ones being all but those that a similar text may lack (its prefix). How many they must
share there, if they are similar, follows from their sizes. So texts meet under the
shingles of their prefixes, those that meet often enough are candidates, and no similar
pair is lost. The order bears on the work only: shingles of one text come first, the
others by how many texts have them, as counted over all texts. So hardly any pairs meet
but similar ones, where half of each text's shingles are its own.

What is counted goes to all tasks in two tables of bounded size: a filter of the shingles
that occur twice, which lets more through where there are more, never less, and for
ranges of shingles the count of the most frequent one. Shingles that occur once needn't
move any further. Entries move packed, by ranges of shingles, each held by a task at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_array, lean, raw_bytes, slices
from .textvec import mix, span_hash, words

#: Bits of a shingle by which its count is looked up (16 MB).
COUNT_BITS = 24
#: Bytes of text whose entries are in one range, or so.
PART_BYTES = 1 << 25
#: Bits of the filter of repeated shingles, at most (32 MB).
FILTER_BITS = 28
#: Entries and pairs that a task packs at a time.
BUFFER = 1 << 18
#: Low bits of an id that tell texts of a group apart.
WITHIN = 24
_ENTRY = np.dtype([("shingle", "<u4"), ("size", "<u4"), ("id", "<u8")])


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 32-bit hashes of each text's word triples (of all its words where it has fewer than three), and the bounds of the texts."""
    data, off = raw_bytes(col)
    n = len(col)
    start, end, first = words(data, off)
    h = span_hash(data, start, end) if len(start) else np.zeros(0, np.uint64)
    h = np.concatenate([h, np.zeros(2, np.uint64)])
    size = np.diff(first)
    take = np.where(size >= 3, size - 2, np.minimum(size, 1))
    owner = np.repeat(np.arange(n), take)
    at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + first[:-1][owner]
    room = np.minimum(size[owner], 3)
    x = mix(h[at] * np.uint64(5) + np.where(room > 1, h[at + 1], np.uint64(0)) * np.uint64(3) + np.where(room > 2, h[at + 2], np.uint64(0)))
    key = np.unique((owner.astype(np.uint64) << np.uint64(32)) | (x >> np.uint64(32)))
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted((key >> np.uint64(32)).astype(np.int64), np.arange(n + 1))


def _similar_part(size: np.ndarray, similarity: float) -> np.ndarray:
    """How many of its shingles a text shares with a similar one at least."""
    return np.ceil(similarity * size - 1e-9).astype(np.int64)


def counts(x: np.ndarray, deep: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that agree in their first bits to their part of the filter of those that occur twice, by their first deep bits, and of the ranks by COUNT_BITS: 0 where none does, else it grows with the logarithm of the highest count."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    n, value = np.diff(np.append(first, len(x))), x[first]
    n, value = n[n > 1], value[n > 1]
    hit = np.zeros(1 << (deep - bits), bool)
    hit[(value >> np.uint32(32 - deep)) & np.uint32(len(hit) - 1)] = True
    rank = np.zeros(1 << (COUNT_BITS - bits), np.uint8)
    np.maximum.at(rank, (value >> np.uint32(32 - COUNT_BITS)) & np.uint32(len(rank) - 1), np.minimum(4 * np.log2(n), 255).astype(np.uint8))
    return hit, rank


def _held(filter_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which shingles a filter, packed to bytes, holds."""
    at = values >> np.uint32(32 - (8 * len(filter_)).bit_length() + 1)
    return (filter_[at >> np.uint32(3)] >> (np.uint32(7) - (at & np.uint32(7))).astype(np.uint8)) & np.uint8(1) == 1


def prefixes(col: pa.Array, rank: np.ndarray, similarity: float, twice: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of the prefixes of texts, the number of the text of each, and the sizes of all texts' sets; those that the filter twice doesn't hold are first in the order."""
    values, bounds = shingles(col)
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    of = rank[values >> np.uint32(32 - COUNT_BITS)]
    if twice is not None:
        of = np.where(_held(twice, values), of, 0)
    key = (owner.astype(np.uint64) << np.uint64(40)) | (of.astype(np.uint64) << np.uint64(32)) | values
    key.sort()
    first = np.arange(len(key)) - bounds[:-1][owner] <= (size - _similar_part(size, similarity))[owner]
    return key[first].astype(np.uint32), owner[first], size


def _scattered(runs, bits: int):
    """Arrays of shingles or entries to batches (part, data), a part being a range of shingles: sorted, all first bytes of them, all second ones and so on, which the shuffle compresses better."""
    kept, n = [], 0

    def packed():
        x = np.concatenate(kept)
        x = x[np.argsort(x["shingle"], kind="stable")] if x.dtype.names else np.sort(x)
        part = (x["shingle"] if x.dtype.names else x).astype(np.uint64) >> np.uint64(32 - bits)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends, rows = np.append(first, len(x)), x.view(np.uint8).reshape(len(x), x.itemsize)
        data = np.concatenate([rows[a:b].T.ravel() for a, b in zip(ends[:-1], ends[1:])])
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), binary_array(data, ends * x.itemsize)], names=["part", "data"])

    for x in runs:
        kept, n = [*kept, x] if len(x) else kept, n + len(x)
        if n >= BUFFER:
            yield packed()
            kept, n = [], 0
    if kept:
        yield packed()


def _gathered(batches, dtype):
    """Rows (part, data), a part's rows together, to the parts and all that each has."""
    now, kept = None, []
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if part != now and kept:
                yield now, np.concatenate(kept)
                kept = []
            now = part
            kept.append(np.frombuffer(data.as_buffer(), np.uint8).reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).ravel())
    if kept:
        yield now, np.concatenate(kept)


def _ends(new: np.ndarray) -> np.ndarray:
    """For each element the end of its run; new tells for all but the first whether a run begins there."""
    last = np.append(np.flatnonzero(new) + 1, len(new) + 1)
    return last[np.searchsorted(last, np.arange(len(new) + 1), "right")]


def meetings(x: np.ndarray, similarity: float):
    """Entries to arrays (a, b, need, n): ids of different groups, the shingles that they share here, and how many they must share in all, if they are similar."""
    x = x[np.lexsort((x["size"], x["id"], x["shingle"]))]
    if not len(x):
        return
    s, size, ident = x["shingle"], x["size"].astype(np.int64), x["id"]
    fresh = np.append(True, (s[1:] != s[:-1]) | (ident[1:] != ident[:-1]) | (size[1:] != size[:-1]))
    s, size, ident = s[fresh], size[fresh], ident[fresh]
    group = ident >> np.uint64(WITHIN)
    list_end = _ends(s[1:] != s[:-1])
    other = _ends((s[1:] != s[:-1]) | (group[1:] != group[:-1]))
    part = _similar_part(size, similarity)
    kept, n = [], 0

    def counted():
        a, b, need = (np.concatenate([k[c] for k in kept]) for c in range(3))
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return a[first], b[first], np.minimum.reduceat(need, first), np.diff(np.append(first, len(a)))

    i, d = np.flatnonzero(other < list_end), 0
    while len(i):
        j = other[i] + d
        ok = np.minimum(size[i], size[j]) >= np.maximum(part[i], part[j])
        p, q = i[ok], j[ok]
        need = np.ceil(similarity / (1 + similarity) * (size[p] + size[q]) - 1e-9).astype(np.int64) - np.maximum(part[p], part[q]) + 1
        kept.append((np.minimum(ident[p], ident[q]), np.maximum(ident[p], ident[q]), need))
        n, d = n + len(p), d + 1
        if n >= BUFFER:
            yield counted()
            kept, n = [], 0
        i = i[other[i] + d < list_end[i]]
    if n:
        yield counted()


def candidates(texts: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """texts (key, text), and units (key, id), ids being the same above their lowest bits WITHIN for the texts of a group, to pairs (a, b) of ids: among them all those of similar texts of different groups."""
    sc = texts.sparkSession.sparkContext
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = math.ceil(math.log2(max(1, size / PART_BYTES, min(size >> 20, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
    deep = min(FILTER_BITS, max(bits + 3, math.ceil(math.log2(size / 3 + 8))))

    def all_of(batches):
        yield from _scattered((shingles(b.column(0)[i:j])[0] for b in batches for i, j in slices(b.column(0))), bits)

    def counted(batches):
        for part, x in _gathered(batches, "<u4"):
            x.sort()
            hit, rank = counts(x, deep, bits)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(hit).tobytes()]), pa.array([rank.tobytes()])], names=["part", "hit", "rank"])

    by_part = lambda df: df.repartition("part").sortWithinPartitions("part")
    found = by_part(texts.select("text").mapInArrow(lean(all_of), "part int, data binary")).mapInArrow(lean(counted), "part int, hit binary, rank binary").toArrow()
    tables = np.zeros((1 << bits, 1 << (deep - bits - 3)), np.uint8), np.zeros((1 << bits, 1 << (COUNT_BITS - bits)), np.uint8)
    for table, name in zip(tables, ("hit", "rank")):
        for part, data in zip(found["part"].to_pylist(), found[name]):
            table[part] = np.frombuffer(data.as_buffer(), np.uint8)
    twice, rank = (sc.broadcast(table.ravel()) for table in tables)
    del found, tables

    def surviving(batches):
        for batch in batches:
            for i, j in slices(batch.column(1)):
                values, owner, size = prefixes(batch.column(1)[i:j], rank.value, similarity, twice.value)
                hit = _held(twice.value, values)
                bounds = np.searchsorted(owner[hit], np.arange(j - i + 1))
                out = pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(size), binary_array(values[hit].view(np.uint8), bounds * 4)], names=["key", "size", "data"])
                yield out.filter(pa.array(np.diff(bounds) > 0))

    def entries(batches):
        def runs():
            for batch in batches:
                data, off = raw_bytes(batch.column(2))
                x = np.empty(len(data) // 4, _ENTRY)
                x["shingle"] = data.view(np.uint32)
                for name, k in (("id", 0), ("size", 1)):
                    x[name] = np.repeat(batch.column(k).to_numpy(), np.diff(off) // 4).astype(_ENTRY[name])
                yield x

        yield from _scattered(runs(), bits)

    def pairs(batches):
        for _, x in _gathered(batches, _ENTRY):
            for a, b, need, n in meetings(x, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(need), pa.array(n)], names=["a", "b", "need", "n"])

    kept = texts.select("key", "text").mapInArrow(lean(surviving), "key bigint, size bigint, data binary").join(units.select("key", "id"), "key").select("id", "size", "data")
    met = by_part(kept.mapInArrow(lean(entries), "part int, data binary")).mapInArrow(lean(pairs), "a bigint, b bigint, need bigint, n bigint")
    # pairs are counted already where they met: counting them once more before the shuffle would only fill memory
    return met.repartition("a", "b").groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("n").alias("n")).where("n >= need").select("a", "b")
