import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from skeinwork.llm import langid, links, packing, simhash

from .test_packing import check
from .test_simhash import brute, edited

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs)
    kept = [r for r in docs.collect() if model.label(pa.array([r.text]))[0].as_py()["lang"] != "und"]
    seen: set = set()
    first = [r for r in sorted(kept, key=lambda r: r.doc_id) if r.text not in seen and not seen.add(r.text)]
    gone = brute([(r.doc_id, r.text) for r in first])[1]
    left = [r for r in first if r.doc_id not in gone]
    rows = corpus_pipeline.run(spark, small).collect()
    got = {r.doc_id for r in rows}
    assert got >= {r.doc_id for r in left} and len(got) <= len(left) + 0.1 * len(gone)
    check([r for r in first if r.doc_id in got], rows, packing.CAPACITY)


def test_stages(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "best-fit packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == COLUMNS and 0 < out.count() <= docs.count()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", None, 0), (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, "a b c", None, None, None)]])
def test_odd_rows(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == (1 if len(rows) > 1 else len(rows))


def near_pairs(rng, n):
    """Texts of which many have an edited copy near the threshold, on both sides of it, and some share long passages."""
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(n):
        words = [f"w{x}" for x in rng.integers(0, 50_000, int(rng.integers(3, 200)))]
        words = words + passage if k % 10 == 0 else words
        rows.append((2 * k, " ".join(words)))
        other = edited(rng, words, ("replaced", "cut", "extended")[k % 3], (0.48, 0.5, 0.52, 0.6)[k // 3 % 4])
        if other:
            rows.append((2 * k + 1, " ".join(other)))
    return rows


def test_near_loses_no_link(spark):
    """All pairs at the threshold are found, far from what the forest's recall and radius promise."""
    rows = near_pairs(np.random.default_rng(21), 1500)
    left = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - brute(rows)[1]


def test_near_loses_no_link_in_leaves_that_stay_deep(spark, monkeypatch):
    """With tries that part nearly all copies and never climb, the rounds end at once; the links are found nevertheless."""
    forest = simhash._forest
    monkeypatch.setattr(simhash, "_forest", lambda nodes, n, shape, radius, leaf, turn=0: forest(nodes, n, (0, 1), radius, 2, turn))
    rng = np.random.default_rng(22)
    base = [f"w{k}" for k in range(120)]
    # a chain: neighbours are similar, others aren't; and copies of one text
    rows = [(k, " ".join(f"c{x}" for x in range(30 * k, 30 * k + 120))) for k in range(40)]
    rows += [(100 + k, " ".join(edited(rng, base, "replaced", 0.75))) for k in range(300)]
    left = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - brute(rows)[1]


@pytest.mark.parametrize("similarity", [0.5, 0.7])
def test_prefixes_hold_as_many_common_shingles_as_similar_texts_need(similarity):
    rows = near_pairs(np.random.default_rng(23), 200)
    col = pa.array([t for _, t in rows])
    values, owner, size = links.prefixes(col, np.random.default_rng(1).integers(0, 9, 1 << links.COUNT_BITS).astype(np.uint8), similarity)
    x = np.empty(len(values), links._ENTRY)
    x["shingle"], x["size"], x["id"] = values, size[owner], owner.astype(np.uint64) << np.uint64(links.WITHIN)
    got = {}
    for a, b, need, n in links.meetings(x, similarity):
        got |= {(int(i) >> links.WITHIN, int(j) >> links.WITHIN): k >= m for i, j, k, m in zip(a, b, n, need)}
    v, bounds = links.shingles(col)
    sets = [set(v[i:j].tolist()) for i, j in zip(bounds[:-1], bounds[1:])]
    near = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}
    assert near and all(got[j, i] for i, j in near)
    # and nothing is compared with all others
    assert sum(got.values()) < 3 * len(near) + 400


def test_shared_passages_cost_no_shuffle_of_pairs(spark, monkeypatch):
    """Texts that share a passage, but not half of their triples, don't meet as long as half of the triples are their own, however few of the texts a sample would see."""
    monkeypatch.setattr(links, "SAMPLE", 10, raising=False)
    rng = np.random.default_rng(24)
    passages = [[f"p{k}x{j}" for j in range(60)] for k in range(20)]
    rows = [(k, " ".join([f"w{x}" for x in rng.integers(0, 1 << 40, 100)] + passages[k % 20])) for k in range(3000)]
    rows.append((3000, rows[0][1] + " end"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert [(r.doc_id, r.keep_id) for r in simhash.near_duplicates(docs).collect()] == [(3000, 0)]
    assert written() - before < sum(len(t) for _, t in rows)


def test_counts_tell_shingles_that_occur_once():
    rng = np.random.default_rng(25)
    once, often = np.split(rng.choice(1 << 28, 1200, replace=False).astype(np.uint32), [1000])
    x = np.sort(np.concatenate([once, np.repeat(often, rng.integers(2, 400, 200))])) + np.uint32(5 << 28)  # the part 5 of 16
    hit, rank = links.counts(x, 27, 4)
    whole = np.zeros((16, len(hit) // 8), np.uint8)
    whole[5] = np.packbits(hit)
    held = links._held(whole.ravel(), x)
    repeated = np.isin(x, often + np.uint32(5 << 28))
    assert held[repeated].all() and held[~repeated].mean() < 0.01
    n = np.unique(x, return_counts=True)[1]
    of = rank[(np.unique(x) >> np.uint32(32 - links.COUNT_BITS)) & np.uint32(len(rank) - 1)]
    assert (of[n > 1] >= (4 * np.log2(n[n > 1])).astype(int)).all() and np.corrcoef(of[n > 1], np.log2(n[n > 1]))[0, 1] > 0.99
    assert [a.sum() for a in links.counts(np.zeros(0, np.uint32), 27, 4)] == [0, 0]


def test_packed_parts_come_back_whole():
    rng = np.random.default_rng(26)
    x = np.empty(5000, links._ENTRY)
    for name in x.dtype.names:
        x[name] = rng.integers(0, 1 << 32, len(x))
    for runs, dtype, part in ((np.split(x, [7, 7, 4000]), links._ENTRY, lambda y: y["shingle"]), (np.split(x["shingle"].copy(), [1, 3000]), np.dtype("<u4"), lambda y: y)):
        rows = list(links._gathered(list(links._scattered(iter(runs), 3)), dtype))
        assert [p for p, _ in rows] == list(range(8)) and all((part(y) >> 29 == p).all() for p, y in rows)
        assert sorted(np.concatenate([y for _, y in rows]).tolist()) == sorted(np.concatenate(runs).tolist())
