import gzip
import hashlib
import os

import pytest

from skeinwork.llm import warc
from skeinwork.llm.shared import new_path


def files(path):
    root = path.removeprefix("file://")
    return {f: open(f"{root}/{f}", "rb").read() for f in os.listdir(root) if f.startswith("part-")}


@pytest.fixture(scope="module")
def pages(spark, small):
    p = spark.read.parquet(f"{small}/pages.parquet")
    odd = spark.createDataFrame([(None, None, "x"), (7, "", ""), (8, "http://a b\n/", None), (9, "http://a b\r\n/", "é" * 200_000)], p.schema)
    return p.unionByName(p.limit(5)).unionByName(odd).selectExpr("*", "'x' AS part", "'y' AS digest", "'z' AS record")


def test_round_trip(spark, pages):
    path = new_path(spark, "warc")
    index = warc.write(pages, path, file_bytes=30_000).collect()
    got = files(path)
    assert {r.file: r.bytes for r in warc.manifest(spark, path).collect()} == {f: len(x) for f, x in got.items()} and len(got) > 2
    want = sorted(((r.page_id, r.url, r.html) for r in pages.where("html IS NOT NULL").collect()), key=repr)
    seen, ids = [], set()
    for r in index:
        raw = gzip.decompress(got[r.file][r.offset : r.offset + r.length])
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        assert rest[len(block) :] == b"\r\n\r\n"
        http, _, payload = block.partition(b"\r\n\r\n")
        assert f"Content-Length: {len(payload)}" in http.decode()
        assert fields["WARC-Payload-Digest"] == warc._sha1(payload) == r.payload and fields["WARC-Block-Digest"] == warc._sha1(block)
        assert fields["WARC-Target-URI"] == (r.url and warc.target(r.url) or "about:blank")
        seen.append((r.page_id, r.url, payload.decode()))
        ids.add(fields["WARC-Record-ID"])
    assert sorted(seen, key=repr) == want and len(ids) == len(want)
    # files roll by compressed size, in the order of URLs, and every byte of them belongs to a record
    assert all(len(x) < 30_000 + max(r.length for r in index) + 2000 for x in got.values())
    for f, x in got.items():
        mine = sorted((r.offset, r.length) for r in index if r.file == f)
        assert mine[0][0] == len(warc.info_record(f)) and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:])) and sum(mine[-1]) == len(x)
    urls = [r.url for r in sorted(index, key=lambda r: (r.file, r.offset)) if r.url]
    assert urls == sorted(urls)


def test_same_files_however_rows_are_spread(spark, pages):
    found = []
    for n in (1, 6):
        path = new_path(spark, "warc")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            warc.write(pages.repartition(7 - n), path, file_bytes=40_000)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        found.append({f: hashlib.sha1(x).hexdigest() for f, x in files(path).items()})
    assert found[0] == found[1]


def test_no_rows_and_second_commit(spark, pages):
    path = new_path(spark, "warc")
    assert warc.write(pages.limit(0), path).collect() == [] and warc.manifest(spark, path).collect() == []
    with pytest.raises(FileExistsError):
        warc.write(pages, path)


def test_query(spark, small):
    assert sorted(r.page_id for r in warc.op3_warc_writer(spark, small).collect()) == sorted(r.page_id for r in spark.read.parquet(f"{small}/pages.parquet").collect())
