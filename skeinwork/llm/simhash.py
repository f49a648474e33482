"""Near-duplicate groups by SimHash and an LSH forest.

A text's features are its distinct words and pairs of neighbouring words, without
case and punctuation, each character of scripts without spaces being a word; its
fingerprint has 256 bits. Near copies share half of their word triples (Jaccard
similarity). The farthest such copies are cuts and extensions, whose fingerprints differ
in a quarter of their bits: that is the distance the forest is built for, and the
radius lets pass 19 of 20 of them.

The forest has several tries, each over the bits in an order of its own. A node that
holds more fingerprints than a leaf may is split at its next bit, so prefixes get as long
as the density asks. All tries climb together from the longest prefixes to shorter
ones until a pair at that distance shares a leaf with the target probability; where leaves would get too large
for that, there are more tries. In each leaf all pairs are compared, and those
within the radius are verified by the exact similarity of the texts. Where they are many, a
minimum spanning forest of them is verified first; a tree that its verified edges leave
in several parts is unsettled, and its other pairs are verified too, but for those
whose ends are already in one part. Verified edges make groups (connected components).

Where a leaf's prefix is longer than the climb ended at, since many fingerprints lie close together, its
members go into a further round, in which the best linked member of each group stands for
the group: so the density falls and the prefixes get shorter. The rounds end when no leaf
is that deep, or when hardly any member was joined. No task holds more than
the fingerprints under one node, of PART or so, or the triples of one leaf.

What the forest leaves apart, since no trie brought it together, or beyond the radius, or in
leaves that stay deep, or since another member stood for its group, an exact join of the
texts of different groups finds (links.py). So groups are those of all similar texts.

Defined results: null texts and texts without words have no fingerprint, are in no
group and stay. Of each group the row with the least id stays (null last, then by a
hash of the text); rows that agree in id and text are copies of each other. Ids may
repeat over different texts. Extra columns take no part. Empty tables give none.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .links import WITHIN, candidates, shingles
from .shared import binary_array, bloom, cut, lean, raw_bytes, slices, without
from .textvec import mix, span_hash, words

BITS, WORDS = 256, 4
#: Word triples that two near copies share, as Jaccard similarity.
SIMILARITY = 0.5
#: Probability with which a pair at the farthest distance shares a leaf.
RECALL = 0.95
#: Fingerprints that a leaf holds, at most, where they differ in 64 bits.
LEAF = 4096
#: Fingerprints under the nodes that tasks begin with, or so.
PART = 16 * LEAF
#: Fingerprints that tell where nodes are so dense that tasks begin below them.
SAMPLE = 1 << 16
#: Levels by which a leaf may be deeper than the climb's end, since bits aren't evenly spread.
UNEVEN = 2
_LANES = np.uint64(0x0101010101010101)


def farthest(similarity: float) -> float:
    """The share of bits in which two such copies differ if one is a part of the other."""
    return math.acos(math.sqrt(similarity)) / math.pi


def radius_of(similarity: float) -> tuple[int, int]:
    """Bits that may differ, in the first half (all but one in 700 of the farthest copies) and altogether (19 of 20)."""
    x = farthest(similarity)
    at = lambda bits, sigmas: round(bits * x + sigmas * math.sqrt(bits * x * (1 - x)))
    return at(BITS // 2, 3), at(BITS, 1.645)


def fingerprints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, BITS / 8) bytes, and which texts have none."""
    data, off = raw_bytes(col)
    n = len(col)
    start, end, first = words(data, off)
    h = span_hash(data, start, end) if len(start) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    pair = mix(h[:-1] * np.uint64(3) + h[1:])[text[:-1] == text[1:]] if len(h) else h
    of_pair = text[:-1][text[:-1] == text[1:]] if len(h) else text
    key = np.concatenate([(text << np.uint64(40)) | (h >> np.uint64(24)), (of_pair << np.uint64(40)) | (pair >> np.uint64(24))])
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    owner = (key >> np.uint64(40)).astype(np.int64)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    out, size = np.zeros((n, BITS), np.int32), np.diff(bounds)
    some = np.flatnonzero(size)
    if len(some):
        # counters of eight bits, eight in a word: no run is longer than 255
        cut_at = np.union1d(bounds[:-1][some], np.concatenate([np.arange(a, b, 255) for a, b in zip(bounds[:-1][some], bounds[1:][some])]) if size.max() > 255 else bounds[:-1][some])
        of_run = np.searchsorted(cut_at, bounds[:-1][some])
        f = mix(key & np.uint64((1 << 40) - 1))
        for word in range(BITS // 64):
            for k in range(8):
                lanes = np.add.reduceat((f >> np.uint64(k)) & _LANES, cut_at)
                counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int32), of_run, axis=0)
                out[some, word * 64 + k : word * 64 + 64 : 8] = counts
            f = mix(f + np.uint64(0x632BE59BD9B4E019))
    return np.packbits(out * 2 > size[:, None], axis=1), size == 0


def recall(depth: int, tries: int, far: float) -> float:
    """The chance that fingerprints that differ in that share of bits agree in the first bits of one trie at least."""
    return 1 - (1 - (1 - far) ** depth) ** tries


def climb(n: int, far: float, leaf: int = LEAF, target: float = RECALL) -> tuple[int, int]:
    """The depth to which all tries over n fingerprints climb, from the longest prefixes on, and how many tries it takes to reach the target there."""
    depth, tries = max(0, math.ceil(math.log2(max(n, 1)))), 1
    while recall(depth, tries, far) < target:
        if depth and n / 2 ** (depth - 1) <= leaf:
            depth -= 1
        else:
            tries += 1
    return depth, tries


@lru_cache(None)
def _order(trie: int) -> np.ndarray:
    """The bits that a trie looks at, in order."""
    return np.random.default_rng(1000 + trie).permutation(BITS)[:64]


def _labels(f: np.ndarray, trie: int) -> np.ndarray:
    """The first 64 bits of fingerprints (n, BITS / 8) in a trie's order, as integers."""
    bits = np.unpackbits(f, axis=1)[:, _order(trie)]
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").ravel().astype(np.uint64)


def _distances(a: np.ndarray, b: np.ndarray, first: int = 0, last: int = WORDS) -> np.ndarray:
    """Bits in which each a differs from each b, over words (n, WORDS) from first to last."""
    out = np.bitwise_count(a[:, None, first] ^ b[None, :, first]).astype(np.uint16 if last - first > 3 else np.uint8)
    for k in range(first + 1, last):
        out += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return out


def _near(a: np.ndarray, b: np.ndarray, radius: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of a and b that are within the radius."""
    half = _distances(a, b, 0, WORDS // 2)
    i, j = np.nonzero(half <= radius[0])
    total = half[i, j].astype(np.int64) + np.bitwise_count(a[i, WORDS // 2 :] ^ b[j, WORDS // 2 :]).sum(1)
    good = total <= radius[1]
    return i[good], j[good]


def leaf_edges(f: np.ndarray, radius: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, bool]:
    """The pairs of fingerprints (n, WORDS) within the radius, or, where they are more than two for each, a minimum spanning forest of them, by Prim in linear memory; and whether it is that."""
    n, found, total = len(f), [], 0
    touched = np.zeros(n, bool)
    for a in range(0, n, 128):
        i, j = _near(f[a : a + 128], f[a:], radius)
        i, j = i[j > i], j[j > i]
        total += len(i)
        touched[a + i] = touched[a + j] = True
        found = [*found, (a + i, a + j)] if total <= 2 * n else []
    if total <= 2 * n:
        return *(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1)), False
    out = []
    rest = np.flatnonzero(touched)
    least, by = np.full(len(rest), BITS + 1, np.int64), np.zeros(len(rest), np.int64)
    while len(rest):
        k = int(least.argmin())
        now = rest[k]
        if least[k] <= BITS:
            out.append((by[k], now))
        last = len(rest) - 1
        rest[k], least[k], by[k] = rest[last], least[last], by[last]
        rest, least, by = rest[:last], least[:last], by[:last]
        i = _near(f[now : now + 1], f[rest], radius)[1]
        d = np.bitwise_count(f[now] ^ f[rest[i]]).sum(1)
        closer = i[d < least[i]]
        least[closer], by[closer] = d[d < least[i]], now
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1], True


def _tree_hashes(f: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that the edges (i, j) of a forest over fingerprints (n, WORDS) join, and for each a hash of all nodes of its tree, the same wherever the same nodes make a tree."""
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        root[find(b)] = find(a)
    nodes = np.union1d(i, j)
    tree = np.array([find(x) for x in nodes.tolist()], np.int64)
    total = np.zeros(len(f), np.uint64)
    hashed = mix(f[nodes, 0])
    for k in range(1, WORDS):
        hashed = mix(hashed + f[nodes, k])
    np.add.at(total, tree, hashed)
    return nodes, total[tree]


def verified_pairs(f: np.ndarray, part: np.ndarray, values: np.ndarray, bounds: np.ndarray, radius: tuple[int, int], similarity: float) -> list[tuple[int, int]]:
    """Pairs of fingerprints (n, WORDS) that are within the radius and whose shingles (values from bounds to bounds) are similar, as many as join all that such pairs join, beyond the parts (n) that are joined already."""
    n, part = len(f), part.copy()
    code = np.unique(values, return_inverse=True)[1]
    size = np.diff(bounds)
    degree = np.concatenate([np.bincount(_near(f[a : a + 128], f, radius)[0], minlength=min(128, n - a)) for a in range(0, n, 128)])
    mark = np.zeros(code.max(initial=0) + 1, np.int64)
    out = []
    # those with most neighbours first: they join most, and what is joined needn't be compared
    for k in np.argsort(-degree, kind="stable"):
        to = _near(f[k : k + 1], f, radius)[1]
        to = to[part[to] != part[k]]
        if not len(to):
            continue
        own = code[bounds[k] : bounds[k + 1]]
        mark[own] = 1
        first = np.cumsum(size[to]) - size[to]
        at = np.arange(size[to].sum()) + np.repeat(bounds[to] - first, size[to])
        both = np.add.reduceat(mark[code[at]], first)
        mark[own] = 0
        for j in to[both >= similarity * (size[k] + size[to] - both)]:
            if part[j] != part[k]:
                out.append((int(k), int(j)))
                part[part == part[j]] = part[k]
    return out


def _leaves(label: np.ndarray, depth: int, leaf: int):
    """Ranges of sorted 64-bit labels under a node of that depth, and their depths: nodes that hold no more than a leaf, or whose labels are equal."""
    todo = [(0, len(label), depth)]
    while todo:
        a, b, depth = todo.pop()
        if b - a <= leaf or depth >= 64:
            if b - a > 1:
                yield a, b, depth
            continue
        m = a + int(np.searchsorted((label[a:b] >> np.uint64(63 - depth)) & np.uint64(1), 1))
        todo += [(a, m, depth + 1), (m, b, depth + 1)]


def _crowded(sample: np.ndarray, scale: float, trie: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the nodes begin that tasks begin with, and their depths, by a sample of which each stands for scale fingerprints."""
    label = np.sort(_labels(sample, trie))
    todo, out = [(0, len(label), 0, 0)], []
    while todo:
        a, b, depth, first = todo.pop()
        # 32 of a sample tell that a node holds far more than a leaf
        if b - a < 32 or (b - a) * scale <= part or depth >= 64:
            out.append((first, depth))
            continue
        m = a + int(np.searchsorted((label[a:b] >> np.uint64(63 - depth)) & np.uint64(1), 1))
        todo += [(a, m, depth + 1, first), (m, b, depth + 1, first | 1 << (63 - depth))]
    out.sort()
    return np.array([x for x, _ in out], np.uint64), np.array([d for _, d in out], np.int64)


def candidate_edges(nodes: DataFrame, similarity: float = SIMILARITY, leaf: int = LEAF) -> DataFrame:
    """nodes (f) of distinct fingerprints to pairs (a, b), a < b, within the radius; of a leaf with many, a minimum spanning forest."""
    return _forest(nodes, nodes.count(), climb(nodes.count(), farthest(similarity), leaf), radius_of(similarity), leaf).where("b IS NOT NULL").select("a", "b").distinct()


def _forest(nodes: DataFrame, n: int, shape: tuple[int, int], radius: tuple[int, int], leaf: int, turn: int = 0) -> DataFrame:
    """n nodes (f) to rows (a, b, tree): pairs, tree being null; members a of the trees to which a leaf's pairs were thinned, b being null; and members a of leaves far deeper than shape (depth, tries) has it, both being null."""
    depth, tries = shape
    part = leaf * (PART // LEAF)
    least = max(0, math.ceil(math.log2(max(n, 1) / part)))
    every = math.ceil(n / SAMPLE)
    some = nodes.select("f") if every <= 1 else nodes.select("f").where(F.pmod(F.xxhash64("f"), F.lit(every)) == 0)
    sample = raw_bytes(some.toArrow()["f"])[0].reshape(-1, BITS // 8)
    tasks = nodes.sparkSession.sparkContext.broadcast([_crowded(sample, max(1, every), turn * tries + t, part) for t in range(tries)])  # at most SAMPLE / 32 nodes a trie

    def plant(batches):
        for batch in batches:
            rows = len(batch)
            if not rows:
                continue
            f = raw_bytes(batch.column(0))[0].reshape(-1, BITS // 8)
            for t, (first, deep) in enumerate(tasks.value):
                label = _labels(f, turn * tries + t)
                at = np.maximum(least, deep[np.searchsorted(first, label, "right") - 1])
                prefix = np.where(at > 0, label >> (64 - np.maximum(at, 1)).astype(np.uint64), np.uint64(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, t, np.int32)), pa.array(at.astype(np.int32)), pa.array(prefix.view(np.int64)), batch.column(0)], names=["trie", "at", "prefix", "f"])

    def search(batches):
        kept, mark = [], None

        def edges():
            f = np.concatenate(kept)
            label = _labels(f, turn * tries + mark[0])
            order = np.argsort(label, kind="stable")
            f, label = f[order], label[order]
            words_of = np.ascontiguousarray(f).view(np.uint64)
            found, dense, deep = [], [], []
            for a, b, d in _leaves(label, mark[1], leaf):
                i, j, thinned = leaf_edges(words_of[a:b], radius)
                if len(i):
                    found.append((a + i, a + j))
                if thinned:
                    at, tree = _tree_hashes(words_of[a:b], i, j)
                    dense.append((a + at, tree))
                if d > depth + UNEVEN:
                    deep.append(np.arange(a, b))
            rows = lambda at: binary_array(f[at].ravel(), np.arange(len(at) + 1) * (BITS // 8))
            batch = lambda a, b, tree: pa.RecordBatch.from_arrays([a, b, tree], names=["a", "b", "tree"])
            if found:
                i, j = (np.concatenate([x[k] for x in found]) for k in (0, 1))
                big = np.ascontiguousarray(f).view(">u8").astype(np.uint64)
                differ = (big[i] != big[j]).argmax(1)
                swap = big[i, differ] > big[j, differ]
                yield batch(rows(np.where(swap, j, i)), rows(np.where(swap, i, j)), pa.nulls(len(i), pa.int64()))
            if dense:
                m, tree = (np.concatenate([x[k] for x in dense]) for k in (0, 1))
                yield batch(rows(m), pa.nulls(len(m), pa.binary()), pa.array(tree.view(np.int64)))
            if deep:
                m = np.concatenate(deep)
                yield batch(rows(m), pa.nulls(len(m), pa.binary()), pa.nulls(len(m), pa.int64()))

        for batch in batches:
            if not len(batch):
                continue
            t, at, prefix = (batch.column(k).to_numpy() for k in range(3))
            f = raw_bytes(batch.column(3))[0].reshape(-1, BITS // 8)
            ends = np.append(np.flatnonzero((t[1:] != t[:-1]) | (at[1:] != at[:-1]) | (prefix[1:] != prefix[:-1])) + 1, len(t))
            for a, b in zip(np.append(0, ends[:-1]), ends):
                now = (int(t[a]), int(at[a]), int(prefix[a]))
                if mark is not None and mark != now:
                    yield from edges()
                    kept = []
                mark = now
                kept.append(f[a:b])
        if kept:
            yield from edges()

    planted = nodes.select("f").mapInArrow(lean(plant), "trie int, at int, prefix bigint, f binary")
    return planted.repartition("trie", "at", "prefix").sortWithinPartitions("trie", "at", "prefix").mapInArrow(lean(search), "a binary, b binary, tree bigint")


def _sets(batches):
    """Rows (f, text) to (f, s), s being the text's shingles."""
    for batch in batches:
        for i, j in slices(batch.column(1)):
            values, bounds = shingles(batch.column(1)[i:j])
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], binary_array(values.view(np.uint8), bounds * 4)], names=["f", "s"])


def _shingled(edges: DataFrame, nodes: DataFrame, docs: DataFrame, repeats: bool) -> DataFrame:
    """The ends of the edges with their texts' shingles, (f, s); docs (doc_id, text, key), repeats whether some of its rows agree in id and text."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("f")).distinct().join(nodes.select("f", "rep"), "f").select("f", F.col("rep.id").alias("rep_id"), F.col("rep.key").alias("rep_key"))
    ends = cut(ends, "ends")
    # most texts have no near copy: they needn't be shuffled
    texts = docs.where(bloom(ends.select("rep_key"), ends.count())(F.col("key"))).join(ends, (F.col("key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("f", "text")
    known = texts.mapInArrow(lean(_sets), "f binary, s binary")
    return cut(known.dropDuplicates(["f"]) if repeats else known, "shingles")


def _verify(edges: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The edges whose ends' texts are similar; known (f, s)."""

    def close(batches):
        for batch in batches:
            (va, oa), (vb, ob) = (raw_bytes(batch.column(k)) for k in (2, 3))
            va, vb, oa, ob = va.view(np.uint32), vb.view(np.uint32), oa // 4, ob // 4
            good = np.zeros(len(batch), bool)
            for k in range(len(batch)):
                x, y = va[oa[k] : oa[k + 1]], vb[ob[k] : ob[k + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[k] = both >= similarity * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(good))

    at = lambda k: known.select(F.col("f").alias(k), F.col("s").alias("s" + k))
    kind = edges.schema["a"].dataType.simpleString()
    return edges.join(at("a"), "a").join(at("b"), "b").select("a", "b", "sa", "sb").mapInArrow(lean(close), f"a {kind}, b {kind}")


def _settle(dense: DataFrame, roots: DataFrame, known: DataFrame, radius: tuple[int, int], similarity: float) -> DataFrame:
    """Further verified edges (a, b) in the trees (tree, f) that the components (node, root) of the edges verified so far leave in several parts."""

    def search(batches):
        kept: list[pa.RecordBatch] = []

        def edges():
            rows = pa.Table.from_batches(kept).combine_chunks()
            f, root = (raw_bytes(rows.column(k))[0].reshape(-1, BITS // 8) for k in (1, 2))
            values, bounds = raw_bytes(rows.column(3))
            part = np.unique(np.ascontiguousarray(root).view(f"V{BITS // 8}").ravel(), return_inverse=True)[1]
            pairs = np.array(verified_pairs(np.ascontiguousarray(f).view(np.uint64), part, values.view(np.uint32), bounds // 4, radius, similarity), np.int64).reshape(-1, 2)
            at = np.arange(len(pairs) + 1) * (BITS // 8)
            yield pa.RecordBatch.from_arrays([binary_array(f[pairs[:, k]].ravel(), at) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            tree = batch.column(0).to_numpy()
            starts = [0, *(np.flatnonzero(tree[1:] != tree[:-1]) + 1).tolist(), len(tree)]
            for a, b in zip(starts[:-1], starts[1:]):
                if kept and kept[-1].column(0)[0].as_py() != tree[a]:
                    yield from edges()
                    kept = []
                kept.append(batch.slice(a, b - a))
        if kept:
            yield from edges()

    parts = dense.join(roots.withColumnRenamed("node", "f"), "f", "left").select("tree", "f", F.coalesce("root", "f").alias("root"))
    parts = cut(parts, "trees")
    several = parts.groupBy("tree").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("tree")
    open_ = parts.join(several, "tree").join(known, "f").select("tree", "f", "root", "s")
    return open_.repartition("tree").sortWithinPartitions("tree").mapInArrow(lean(search), "a binary, b binary")


def _hubs(deep: DataFrame, roots: DataFrame, links: DataFrame) -> tuple[int, DataFrame]:
    """How many nodes (f) there are, and of them those in no group and the one of each group that has most links."""
    ends = links.select(F.explode(F.array("a", "b")).alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    named = deep.join(roots.withColumnRenamed("node", "f"), "f", "left").join(ends, "f", "left").select("f", F.coalesce("root", "f").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    named = cut(named, "deep")
    return named.count(), cut(named.groupBy("root").agg(F.max_by("f", F.struct("n", "f")).alias("f")).select("f"), "hubs")


def _completed(roots: DataFrame, prints: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The components (node, root) with all links between texts of different ones; prints (f, key), docs (text, key)."""
    named = prints.select("f", "key").distinct().join(roots.withColumnRenamed("node", "f"), "f", "left")
    low = F.lit((1 << WITHIN) - 1)
    units = cut(named.select("f", "key", F.xxhash64(F.coalesce("root", "f")).bitwiseAND(F.bitwise_not(low.cast("long"))).bitwiseOR(F.xxhash64("key").bitwiseAND(low)).alias("id")), "units")
    pairs = cut(candidates(docs.select("key", "text"), units, similarity), "apart")
    if pairs.isEmpty():
        return roots
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(units, "id").select("id", "key"), "apart-ends")
    texts = docs.where(bloom(ends.select("key"), ends.count())(F.col("key"))).join(ends, "key").select(F.col("id").alias("f"), "text")
    known = cut(texts.mapInArrow(lean(_sets), "f bigint, s binary").distinct(), "apart-shingles")
    at = lambda k: units.select(F.col("id").alias(k), F.col("f").alias("f" + k))
    more = _verify(pairs, known, similarity).distinct().join(at("a"), "a").join(at("b"), "b").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"))
    more = cut(more.distinct(), "joined")
    return roots if more.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows that are in a group of near copies: (doc_id, key, n, keep_id, is_kept). key hashes the text; n counts the rows that agree in both."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("key")).where("text IS NOT NULL")
    id_type = own.schema["doc_id"].dataType.simpleString()

    def fingerprint(batches):
        for batch in batches:
            for i, j in slices(batch.column(1)):
                f, none = fingerprints(batch.column(1)[i:j])
                out = pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], binary_array(f.ravel(), np.arange(j - i + 1) * (BITS // 8))], names=["doc_id", "key", "f"])
                yield out.filter(pa.array(~none))

    prints = own.mapInArrow(lean(fingerprint), f"doc_id {id_type}, key bigint, f binary")
    prints = cut(prints.groupBy("f", "doc_id", "key").agg(F.count("*").alias("n")), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("key"))
    nodes = cut(prints.groupBy("f").agg(F.min(rank).alias("rep"), F.sum("n").alias("size")), "nodes")
    n = nodes.count()
    shape, radius = climb(n, farthest(similarity)), radius_of(similarity)
    repeats = not prints.where("n > 1").isEmpty()
    todo, size, turn, links = nodes.select("f"), n, 0, None
    while True:
        found = cut(_forest(todo, size, shape, radius, LEAF, turn), "forest")
        edges = cut(found.where("b IS NOT NULL").select("a", "b").distinct(), "candidates")
        known = _shingled(edges, nodes, own, repeats)
        verified = cut(_verify(edges, known, similarity), "verified")
        links = verified if links is None else links.unionByName(verified)
        roots = components(links)
        dense = found.where("tree IS NOT NULL").select("tree", F.col("a").alias("f")).distinct()
        if not dense.isEmpty():
            more = cut(_settle(dense, cut(roots, "roots"), known, radius, similarity), "settled")
            if not more.isEmpty():
                links = links.unionByName(more)
                roots = components(links)
        deep = found.where("b IS NULL AND tree IS NULL").select(F.col("a").alias("f")).distinct()
        if deep.isEmpty():
            break
        before, todo = _hubs(deep, roots, links)
        size, turn = todo.count(), turn + 1
        if size > 0.9 * before:
            break
    roots = _completed(cut(roots, "roots"), prints, own, similarity)
    grouped = nodes.join(roots, nodes["f"] == roots["node"], "left").select("f", "rep", "size", F.coalesce("root", "f").alias("root"))
    groups = grouped.groupBy("root").agg(F.min("rep").alias("keep"), F.sum("size").alias("all")).where(F.col("all") > 1)
    members = grouped.join(groups, "root").select("f", "keep")
    return prints.join(members, "f").select("doc_id", "key", "n", F.col("keep.id").alias("keep_id"), (F.col("doc_id").eqNullSafe(F.col("keep.id")) & (F.col("key") == F.col("keep.key"))).alias("is_kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row (doc_id, keep_id) for each row of docs that goes, keep_id being the one of its group that stays."""
    found = decide(docs, id_col, text_col, similarity).withColumn("gone", F.col("n") - F.col("is_kept").cast("int")).where("gone > 0")
    return found.select("doc_id", "keep_id", F.explode(F.sequence(F.lit(1), F.col("gone"))).alias("k")).drop("k")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs, with all its columns, less the near copies of rows that stay."""
    found = cut(decide(docs, id_col, text_col, similarity), "near-decisions")
    return without(docs, id_col, F.when(F.col(f"`{text_col}`").isNotNull(), F.xxhash64(F.col(f"`{text_col}`"))), found.where("NOT is_kept OR n > 1").select("doc_id", "key", (~F.col("is_kept")).alias("gone")))


def op8_simhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
