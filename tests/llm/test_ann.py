import numpy as np
import pytest

from skeinwork.llm import ann


def recall(df, rows, k=10, every=1):
    """The recall of the neighbours of the rows whose id is divisible by every, against all rows; asserts that nothing else is there."""
    d = df.collect()
    x = np.array([r.embedding for r in d], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -9)
    at = {r.vec_id: i for i, r in enumerate(d)}
    assert len(rows) == sum(r.vec_id % every == 0 for r in d) * k and all(r.vec_id % every == 0 for r in rows) and all(abs(s[at[r.vec_id], at[r.neighbour_id]] - r.similarity) < 1e-5 for r in rows)
    assert len({(r.vec_id, r.rank) for r in rows}) == len({(r.vec_id, r.neighbour_id) for r in rows}) == len(rows)
    kth = -np.sort(-s, 1)[:, k - 1]
    return np.mean([s[at[r.vec_id], at[r.neighbour_id]] >= kth[at[r.vec_id]] - 1e-6 for r in rows])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    assert recall(spark.read.parquet(f"{folder}/embeddings.parquet"), ann.op1_ann(spark, folder).collect(), every=20) >= 0.94


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_all_rows(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    assert recall(df, ann.neighbours(df).collect()) >= 0.94


def test_results_do_not_depend_on_blocks_or_sample(spark, monkeypatch):
    """Many shards, small blocks and a small fitted sample: every row is indexed all the same."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    monkeypatch.setattr(ann, "SHARD_BYTES", 1 << 15)
    monkeypatch.setattr(ann, "BLOCK_VALUES", 1 << 12)
    monkeypatch.setattr(ann, "FIT", 2)
    assert recall(df, ann.neighbours(df, asks=df.vec_id % 20 == 0).collect(), every=20) >= 0.9


def test_recall_with_clusters_and_copies(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(60, 23))
    x = c[np.minimum(rng.integers(0, 120, 3000), 59)] + rng.normal(size=(3000, 23)) * 0.2
    x[100:400] = x[100] + rng.normal(size=(300, 23)) * 1e-3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    assert recall(df, ann.neighbours(df).collect()) >= 0.92


def test_recall_in_a_dense_group(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(5000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:1000] = x[0] + rng.normal(size=(1000, 64)) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.neighbours(df).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    s = x[:1000] @ x.T
    s[np.arange(1000), np.arange(1000)] = -9
    best = np.argsort(-s, 1)[:, :10]
    found = np.mean([len(got[i] & set(best[i].tolist())) / 10 for i in range(1000)])
    print("recall in the group", found)
    assert found >= 0.9


def test_fewer_lists_are_probed_where_vectors_cluster():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(50, 16)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1)[:, None]
    index = ann.Index(c, np.full(50, 100.0), np.full(50, 0.02), np.zeros((16, 1, 1), np.float32), 4)
    assert index.probed(c, 10, 0.96).sum(1).max() <= 3
    index = ann.Index(c, np.full(50, 100.0), np.full(50, 0.5), np.zeros((16, 1, 1), np.float32), 4)
    assert index.probed(c, 10, 0.96).sum(1).min() > 3


def test_odd_vectors(spark):
    rows = [(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [1.0]), (7, [-1.0, 1.0]), (8, []), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<float>, uid string, list string")
    got = sorted(((r.vec_id, r.rank, r.neighbour_id) for r in ann.neighbours(df).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (1, 2, None), (1, 3, 7)] * 2 + [(None, 1, 1), (None, 2, 1), (None, 3, 7), (7, 1, 1), (7, 2, 1), (7, 3, None)], key=repr)
    assert ann.neighbours(df.limit(0)).collect() == [] and ann.neighbours(df.where("vec_id = 7")).collect() == []


def test_a_long_list_is_split_over_shards(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.ones((900, 8)) + rng.normal(size=(900, 8)) * 1e-3, rng.normal(size=(100, 8))])
    index = ann.Index(np.eye(8, dtype=np.float32), np.array([900.0, *[14.0] * 7]), np.full(8, 0.1), np.zeros((8, 1, 1), np.float32), 4)
    assert index.split[0] > 1 and len(index.parent) == index.split.sum()
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    assert recall(df, ann.neighbours(df).collect()) >= 0.9
