import pytest

from skeinwork.llm import exactdedup
from skeinwork.llm.shared import new_path

SCHEMA = "doc_id bigint, text string, digest string, keep_id string, n int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1, "c") for r in rows], SCHEMA)


ROWS = [(3, "x"), (1, "x"), (2, None), (4, ""), (5, ""), (6, "y"), (6, "y"), (6, "z"), (None, "z"), (None, "w"), (7, None), (None, "v"), (None, "v"), (8, "l" * 300_000), (9, "l" * 300_000)]


def brute(rows, known=()):
    """Which rows stay."""
    seen, stay = set(known), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None or t not in seen:
            stay.append((d, t))
        seen.add(t)
    return sorted(stay, key=repr)


def test_batches_against_brute_force(spark):
    path = new_path(spark, "index")
    index = exactdedup.DigestIndex(spark, path, buckets=3)
    got = exactdedup.deduplicated(frame(spark, ROWS), index, "a").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute(ROWS) and got[0].keep_id == "b"
    index.close()
    more = [(0, "x"), (10, "new"), (11, "new"), (12, None), (13, "")]
    again = exactdedup.DigestIndex(spark, path, buckets=7)
    assert again.buckets == 3
    got = exactdedup.deduplicated(frame(spark, more), again, "b").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute(more, {t for _, t in ROWS})
    assert exactdedup.deduplicated(frame(spark, []), again, "c").collect() == []
    assert again.table().count() == len({t for _, t in ROWS + more if t is not None})


@pytest.mark.parametrize("fails", ["before the append", "in the append", "after the append", "after the commit"])
def test_a_batch_that_failed_is_run_again(spark, monkeypatch, fails):
    """Whatever a failed run left behind, the next run under the same name keeps the same rows, and the index has each digest once."""
    index = exactdedup.DigestIndex(spark, new_path(spark, "index"), buckets=2)
    exactdedup.ingest(frame(spark, [(0, "x"), (1, "old")]), index, "first")
    batch = frame(spark, ROWS + [(k, f"text {k}") for k in range(20, 30)])
    if fails == "in the append":  # a part of the rows is there
        index.add(batch.where("doc_id >= 25").selectExpr("unhex(sha2(text, 256)) AS digest", "doc_id AS keep_id"), "second", "")
        index.fs.delete(index._at("batches/second"), False)
    elif fails != "after the commit":
        write = exactdedup.DigestIndex._write
        target = "add" if fails == "before the append" else "_write"
        monkeypatch.setattr(exactdedup.DigestIndex, target, lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            exactdedup.ingest(batch, index, "second")
        monkeypatch.undo()
        assert exactdedup.DigestIndex._write is write and index.committed("second") is None
    else:
        exactdedup.ingest(batch, index, "second")
    got = exactdedup.deduplicated(batch, index, "second").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute([tuple(r)[:2] for r in batch.collect()], {"x", "old"})
    assert index.table().count() == index.table().select("digest").distinct().count() == len({r.text for r in batch.collect() if r.text is not None} | {"old"})
    with pytest.raises(ValueError, match="other rows"):
        exactdedup.ingest(frame(spark, [(1, "else")]), index, "second")


def test_the_index_grows(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "BUCKET_ROWS", 4)
    path = new_path(spark, "index")
    index = exactdedup.DigestIndex(spark, path, buckets=1)
    rows = [(k, f"t{k % 20}") for k in range(40)]
    assert exactdedup.deduplicated(frame(spark, rows), index, "a").count() == 20
    assert index.buckets == 16 and index.table().count() == 20
    assert exactdedup.DigestIndex(spark, path).buckets == 16
    assert exactdedup.deduplicated(frame(spark, rows + [(99, "new")]), index, "b").count() == 1


def test_every_copy_is_reported(spark):
    got = exactdedup.duplicates(frame(spark, ROWS), exactdedup.DigestIndex(spark, new_path(spark, "index")), "a").collect()
    assert sorted(((r.doc_id, r.keep_id) for r in got), key=repr) == sorted([(3, 1), (5, 4), (6, 6), (None, 6), (None, None), (9, 8)], key=repr)


def test_query(spark, medium, against_sql):
    before = len(spark.catalog.listTables())
    against_sql(exactdedup.op9_exact_dedup(spark, medium), exactdedup.SQL, medium)
    assert len(spark.catalog.listTables()) == before
