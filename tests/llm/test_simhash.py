import re
import time

import numpy as np
import pyarrow as pa
import pytest

from skeinwork.llm import components, packing, simhash, textvec
from skeinwork.llm.shared import raw_bytes


def triples(text):
    w = [x.lower() for x in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text)]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def brute(rows, similarity=simhash.SIMILARITY):
    """(pairs of near copies, the rows that go) of rows (doc_id, text), by comparing all."""
    sets = [triples(t) if t else set() for _, t in rows]
    by: dict = {}
    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    both: dict = {}
    for at in by.values():
        for i, a in enumerate(at):
            for b in at[i + 1 :]:
                both[a, b] = both.get((a, b), 0) + 1
    pairs = [p for p, n in both.items() if n >= similarity * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return pairs, {rows[k][0] for k in range(len(rows)) if find(k) != k}, find


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_all_pairs(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    pairs, gone, find = brute(rows)
    got = simhash.op8_simhash_forest(spark, folder).collect()
    at = {d: k for k, (d, _) in enumerate(rows)}
    root = {r.doc_id: r.keep_id for r in got}
    found = sum(root.get(rows[a][0], rows[a][0]) == root.get(rows[b][0], rows[b][0]) for a, b in pairs)
    assert found >= 0.95 * len(pairs)
    assert len(gone & set(root)) >= 0.95 * len(gone)
    # what goes has near copies that lead to what stays
    assert all(find(at[r.doc_id]) == find(at[r.keep_id]) for r in got)


def flipped(rng, rows, bits):
    """rows (n, BITS / 8), each with so many of its bits changed, bits being a number or one for each row."""
    out = np.unpackbits(rows, axis=1)
    for row, k in zip(out, np.broadcast_to(bits, len(rows))):
        row[rng.choice(simhash.BITS, k, replace=False)] ^= 1
    return np.packbits(out, axis=1)


def test_trees_find_close_fingerprints(spark):
    """Pairs at each distance up to the farthest, among others, in leaves of 8: recall is on target, or above it for nearer ones."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (3000, simhash.BITS // 8), dtype=np.uint8)
    levels = [16, 32, 40, 46, 52, 64]
    other = flipped(rng, base, np.repeat(levels, 500))
    nodes = spark.createDataFrame(pa.table({"f": [r.tobytes() for r in np.concatenate([base, other])]}))
    found = {(bytes(r.a), bytes(r.b)) for r in simhash.candidate_edges(nodes, leaf=64).collect()}
    hit = [tuple(sorted((base[k].tobytes(), other[k].tobytes()))) in found for k in range(3000)]
    recall = {d: np.mean(hit[k * 500 : k * 500 + 500]) for k, d in enumerate(levels)}
    assert all(recall[d] >= 0.99 for d in (16, 32, 40)) and all(recall[d] >= 0.95 for d in (46, 52)) and recall[64] >= 0.85
    # two random fingerprints are never that near
    assert len(found) == sum(hit)


@pytest.mark.parametrize("n", [1, 2, 4096, 10**6, 10**9])
def test_the_climb_ends_where_the_target_is_reached(n):
    depth, tries = simhash.climb(n, 0.25)
    assert simhash.recall(depth, tries, 0.25) >= simhash.RECALL and n / 2**depth <= simhash.LEAF
    assert not depth or tries == 1 or simhash.recall(depth, tries - 1, 0.25) < simhash.RECALL


def test_dense_nodes_get_tasks_of_their_own():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 256, (1, simhash.BITS // 8), dtype=np.uint8)
    f = np.concatenate([rng.integers(0, 256, (2000, simhash.BITS // 8), dtype=np.uint8), flipped(rng, np.repeat(one, 2000, 0), rng.integers(0, 20, 2000))])
    first, depth = simhash._crowded(f, 1, 7, 200)
    label = simhash._labels(f, 7)
    at = np.searchsorted(first, label, "right") - 1
    # only fingerprints that agree in all 64 bits can't be parted
    assert np.bincount(at)[depth[: at.max() + 1] < 64].max() <= 200 and depth.max() > depth.min()
    shift = (64 - depth[at]).astype(np.uint64)
    assert (label >> shift == first[at] >> shift).all()  # each is a node: its fingerprints agree in a prefix


def test_a_full_leaf_gives_a_forest_that_joins_what_its_pairs_join():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (40, simhash.BITS // 8), dtype=np.uint8)
    f = np.ascontiguousarray(np.concatenate([flipped(rng, base, 12) for _ in range(70)])).view(np.uint64)
    d = simhash._distances(f, f)
    radius = (128, 30)
    i, j, thinned = simhash.leaf_edges(f, radius)
    assert thinned and (d[i, j] <= 30).all() and len(i) == 2800 - 40
    assert {frozenset(np.flatnonzero(simhash._tree_hashes(f, i, j)[1] == t) % 40) for t in set(simhash._tree_hashes(f, i, j)[1])} == {frozenset([k]) for k in range(40)}
    some = f[::40][:3]
    assert sorted(zip(*simhash.leaf_edges(some, (128, 40))[:2])) == [(a, b) for a in range(3) for b in range(a + 1, 3) if simhash._distances(some, some)[a, b] <= 40]


def test_a_dense_leaf_ends_in_bounded_time():
    rng = np.random.default_rng(7)
    one = rng.integers(0, 256, (1, simhash.BITS // 8), dtype=np.uint8)
    f = np.ascontiguousarray(flipped(rng, np.repeat(one, 5000, 0), 8)).view(np.uint64)
    began = time.time()
    i, j, thinned = simhash.leaf_edges(f, simhash.radius_of(0.5))
    assert thinned and len(i) == 4999 and time.time() - began < 30


def edited(rng, words, kind, j):
    """A text whose word triples have about that Jaccard similarity to those of words: with words replaced, or cut, or extended."""
    n = len(words)
    if kind == "replaced":
        out = list(words)
        for at in rng.choice(n // 3, round(n * (1 - 2 * j / (1 + j)) / 3), replace=False):
            out[3 * at + 1] = f"new{rng.integers(1 << 40)}"
        return out
    if kind == "cut":
        return words[: round(n * j)]
    return words + [f"more{rng.integers(1 << 40)}" for _ in range(round(n / j) - n)]


@pytest.mark.parametrize("n", [500, 4000])
def test_copies_near_the_threshold_are_found(spark, n):
    """Of pairs with similarities between 0.5 and 0.7, made by replacing, cutting and extending, most are found whatever the number of texts."""
    rng = np.random.default_rng(11)
    rows, kinds = [], {}
    for k in range(n):
        words = [f"w{x}" for x in rng.integers(0, 50_000, 200)]
        rows.append((2 * k, " ".join(words)))
        if k < 300:
            kind, j = ("replaced", "cut", "extended")[k % 3], (0.52, 0.6, 0.7)[k // 3 % 3]
            other = " ".join(edited(rng, words, kind, j))
            a, b = triples(rows[-1][1]), triples(other)
            if len(a & b) >= 0.5 * len(a | b):
                kinds.setdefault((kind, j), []).append(2 * k + 1)
                rows.append((2 * k + 1, other))
    got = {r.doc_id: r.keep_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = {x: np.mean([d in got for d in ids]) for x, ids in kinds.items()}
    assert all(k == d - 1 for d, k in got.items())
    assert len(kinds) == 9 and min(found.values()) >= 0.8 and np.mean([d in got for ids in kinds.values() for d in ids]) >= 0.93, found


def test_rounds_climb_where_it_is_dense(spark, monkeypatch):
    """With leaves far smaller than a group of copies of one original, further rounds join what the first one's deep leaves left apart."""
    monkeypatch.setattr(simhash, "LEAF", 64)
    turns = []
    forest = simhash._forest
    monkeypatch.setattr(simhash, "_forest", lambda nodes, n, shape, radius, leaf, turn=0: turns.append((n, turn)) or forest(nodes, n, (1, 6), radius, 64, turn))
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 1001):
        words = list(base)
        for at in rng.choice(200, 6, replace=False):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    got = [r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert len(turns) > 1 and turns[1][0] < 0.5 * turns[0][0]
    assert len(got) >= 990 and {r.keep_id for r in got} == {0}


def test_a_dense_group_keeps_the_edges_that_hold_it_together(spark):
    # copies are similar to the original, but hardly to each other
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 1501):
        words = list(base)
        for at in rng.choice(200, 15, replace=False):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    sets = [triples(t) for _, t in rows]
    near = {k for k in range(1, 1501) if 2 * len(sets[0] & sets[k]) >= len(sets[0] | sets[k])}
    got = {r.doc_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r.keep_id == 0}
    assert len(near) > 1000 and len(near & got) >= 0.9 * len(near)


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (103, 101), (200, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_scripts_without_spaces(spark):
    rng = np.random.default_rng(8)
    chinese = "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 500)) + "\u3002"
    thai = "".join(chr(c) for c in rng.integers(0xE01, 0xE2F, 500))
    rows = [(1, chinese), (2, chinese[:250] + "\u6f22" + chinese[251:]), (3, thai), (4, thai[:250] + "\u0e01" + thai[251:]), (5, "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 500)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.keep_id) for r in simhash.near_duplicates(df).collect()) == [(2, 1), (4, 3)]
    assert [r.n for r in df.orderBy("doc_id").select(packing.word_count(df.text).alias("n")).collect()] == [501, 501, 500, 500, 500]
    cut_up = lambda t: [t.encode()[a:b].decode() for a, b in zip(*textvec.words(*raw_bytes(pa.array([t])))[:2])]
    assert cut_up("a\u201cb\u201d c\u6f22\u5b57d\u3002\u0e01\u0e34\u0e02 \u00e9t\u00e9\u00a0x") == ["a", "b", "c", "\u6f22", "\u5b57", "d", "\u0e01\u0e34", "\u0e02", "\u00e9t\u00e9", "x"]


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    text = " ".join(f"v{k}" for k in range(200))
    rows = [(1, None), (2, ""), (3, "!!!"), (None, text), (5, text + " more"), (5, text + " more"), (6, "One two three"), (7, "one, two: THREE!"), (8, long), (9, long + " end"), (10, "other"), (6, "something else here")]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id bigint, text string, key string, f string, n int")
    got = simhash.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.keep_id) for r in got), key=repr) == sorted([(None, 5), (5, 5), (7, 6), (9, 8)], key=repr)
    stay = simhash.one_of_each(df)
    assert stay.columns == df.columns
    assert sorted(((r.doc_id, (r.text or "")[:9]) for r in stay.collect()), key=repr) == sorted([(1, ""), (2, ""), (3, "!!!"), (5, text[:9]), (6, "One two three"[:9]), (8, long[:9]), (10, "other"), (6, "something")], key=repr)
    assert simhash.near_duplicates(df.limit(0)).collect() == [] and simhash.one_of_each(df.limit(0)).collect() == []
