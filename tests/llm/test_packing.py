import random
from collections import defaultdict

import pytest

from skeinwork.llm import packing


def best_fit_decreasing(sizes, capacity):
    """Bins that sequential best fit opens, by brute force."""
    gaps: list[int] = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps[gaps.index(min(fit))] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


def check(docs, rows, capacity):
    """Every word of every document is in one place, and no bin overflows. Returns the bins of rests."""
    words = defaultdict(list)
    for r in docs:
        words[r.doc_id].append(len((r.text or "").split()))
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        if r.bin_id is None:
            assert r.length == 0
        else:
            assert 0 < r.length <= capacity
            bins[r.bin_id].append((r.place, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= capacity
    assert {k: sum(v) for k, v in words.items()} == {k: sum(n for _, n in v) for k, v in pieces.items()}
    for k, v in words.items():
        if len(v) == 1:
            assert [a for a, _ in sorted(pieces[k])] == [x * capacity for x in range(len(pieces[k]))]
    return sum(1 for own in bins.values() if own[0][1] < capacity or len(own) > 1)


@pytest.mark.parametrize("capacity,parts", [(50, 3), (2048, 4)])
def test_as_full_as_sequential_best_fit(spark, medium, capacity, parts):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = packing.pack(docs.repartition(parts), capacity).collect()
    used = check(docs.collect(), rows, capacity)
    sizes = [n for n in (len((r.text or "").split()) % capacity for r in docs.collect()) if n]
    assert used <= best_fit_decreasing(sizes, capacity) * 1.03 + 1


def test_random_sizes(spark):
    r = random.Random(5)
    for most in (3, 9, 30):
        docs = spark.createDataFrame([(i, " ".join("w" * 1 for _ in range(r.randint(1, most)))) for i in range(300)], "doc_id bigint, text string")
        used = check(docs.collect(), packing.pack(docs, 10).collect(), 10)
        sizes = [n for n in (len(d.text.split()) % 10 for d in docs.collect()) if n]
        assert used <= best_fit_decreasing(sizes, 10) * 1.05 + 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a b"), (4, "a " * 95), (5, "a b"), (5, "a b"), (6, "w " * 200_000), (7, "x " * 10)]
    docs = spark.createDataFrame([(*x, "e", 1, 2) for x in rows], "doc_id bigint, text string, bin_id string, size int, uid int")
    got = packing.pack(docs, 10).collect()
    check(docs.collect(), got, 10)
    assert len([r for r in got if r.doc_id == 6]) == 20_000 and len([r for r in got if r.doc_id == 5]) == 2
    assert {(r.bin_id, r.length) for r in got if r.doc_id in (1, 2, 3)} == {(None, 0)}
    assert packing.pack(docs.limit(0), 10).collect() == []
    assert {r.bin_id for r in packing.pack(docs.where("doc_id IN (1, 2)"), 10).collect()} == {None}


def test_the_same_however_rows_are_spread(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    shape = lambda df: sorted(map(tuple, packing.pack(df, 100).collect()), key=repr)
    assert shape(docs.repartition(1)) == shape(docs.repartition(5))


def test_query(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet").collect(), packing.op2_best_fit_packing(spark, small).collect(), packing.CAPACITY)
