"""A deterministic sharded WARC writer.

Each page becomes a gzip member of its own:
a WARC/1.1 response record whose HTTP headers, lengths, SHA-1 digests and record id
are made anew from the page alone. Records are ordered by URL, id and payload digest; only these keys and the records' sizes
are range-sorted. The files roll by compressed size: a record
belongs to the file in whose stretch of FILE_BYTES, counted over all records in
order, it begins. So the files' bytes depend on the rows only, not on partitions.
The first key of each file, of which there are as many as files, tells every task where a record belongs, and
the compressed records are shuffled once, to as many tasks as there are files.

Each task writes its files under temporary names that hold the attempt; the index of
what succeeded is written to the shared folder; then files that it names are renamed, and
a manifest, renamed into place last, commits the whole. A folder without a manifest
holds nothing; files that the manifest doesn't name don't count. Lost executors
leave temporary files only, which the commit removes.

Defined results: rows without html (null) give no record and no index row; an empty
html gives a record without payload. A null or empty URL is written as about:blank
and sorts last. Control characters and spaces in URLs are percent-encoded. Repeated rows
each get a record; the record id counts them, and they are counted before they are shuffled. Extra columns take no part. An empty
table gives a manifest without files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bloom, cut, drop_path, lean, new_path

#: Compressed bytes after which the next file begins.
FILE_BYTES = 256 << 20
#: The time that records carry; pages have none.
DATE = "2020-01-01T00:00:00Z"
LEVEL = 6
MANIFEST = "_manifest"
#: Copies of a page that one task makes at a time.
_BLOCK = 10_000
_SPACE = uuid.UUID("5b0d1c0e-8f2a-5f0e-9a43-3f0a7c9d2b11")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def target(url: str | None) -> str:
    """The URL as a header may hold it."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as a gzip member without a time of its own."""
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    raw = "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, LEVEL, mtime=0)


def page_record(page_id, url: str | None, html: bytes, copy: int, date: str = DATE) -> tuple[bytes, str]:
    """The record of a page, and its payload's digest. copy counts equal pages from 0."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html
    payload = _sha1(html)
    ident = uuid.uuid5(_SPACE, f"{page_id}\n{url}\n{payload}\n{copy}")
    fields = [("WARC-Record-ID", f"<urn:uuid:{ident}>"), ("WARC-Date", date), ("WARC-Target-URI", target(url)), ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response")]
    return record("response", fields, block), payload


def info_record(name: str, date: str = DATE) -> bytes:
    """The record that begins each file."""
    block = b"format: WARC File Format 1.1\r\nsoftware: skeinwork\r\n"
    return record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/warc-fields")], block)


def file_name(number: int) -> str:
    return f"part-{number:08d}.warc.gz"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


_KEY = ["url", "page_id", "digest", "copy"]


def _compress(date: str, whole: bool):
    """Rows (url, page_id, digest, copy, html) to (url, page_id, digest, copy, payload, size, record), or, if not whole, to (url, page_id, digest, copy, size)."""

    def run(batches):
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in range(4)]
            done, size, begin = [], 0, 0
            for k, html in enumerate(batch.column(4).cast(pa.binary())):
                gz, payload = page_record(keys[1][k], keys[0][k], html.as_py(), keys[3][k], date)
                done.append((gz, payload, len(gz)) if whole else (None, None, len(gz)))
                size += done[-1][2] if whole else 0
                if size > 1 << 24 or k + 1 == len(batch):
                    records, payloads, sizes = zip(*done)
                    own = [batch.column(c)[begin : k + 1] for c in range(4)]
                    if whole:
                        yield pa.RecordBatch.from_arrays([*own, pa.array(payloads, pa.string()), pa.array(sizes, pa.int64()), pa.array(records, pa.binary())], names=[*_KEY, "payload", "size", "record"])
                    else:
                        yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64())], names=[*_KEY, "size"])
                    done, size, begin = [], 0, k + 1

    return run


def _place(url, page_id, digest, copy) -> tuple:
    """A record's place among all, as Spark orders them: without URL last, nulls last."""
    return not url, url is None, url or "", page_id is None, page_id if page_id is not None else 0, digest, copy


def _numbered(own: DataFrame, page: list[str]) -> DataFrame:
    """own (url, page_id, digest, html) with copy, which counts rows that are equal in page, from 0. Only keys of rows that have copies are shuffled with their html, once each."""
    several = cut(own.groupBy(*page).agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    known = several.count()
    if not known:
        return own.withColumn("copy", F.lit(0).cast("bigint"))
    key = F.xxhash64(*page)
    may_be = bloom(several.select(key.alias("key")), known)
    some = own.where(may_be(key)).groupBy(*page).agg(F.count("*").alias("n"), F.any_value("html").alias("html"))
    # a page with very many copies is spread before they are made
    blocks = some.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(_BLOCK)))).repartition(*page, "first")
    made = blocks.withColumn("copy", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + _BLOCK, F.col("n")) - 1)))
    columns = [*page, "html", "copy"]
    return own.where(~may_be(key)).withColumn("copy", F.lit(0).cast("bigint")).select(*columns).unionByName(made.select(*columns))


def write(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the files and their manifest below path, which must not hold a manifest yet. Returns the index: a row (page_id, url, file, offset, length, payload) for each record."""
    spark = pages.sparkSession
    fs, root = _open(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{path} is committed already")
    own = pages.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{id_col}`").alias("page_id"), F.sha1(F.col(f"`{html_col}`").cast("binary")).alias("digest"), F.col(f"`{html_col}`").alias("html")).where("html IS NOT NULL")
    id_type = own.schema["page_id"].dataType.simpleString()
    shape = f"url string, page_id {id_type}, digest string, copy bigint"
    made = _numbered(own, _KEY[:3]).select(*_KEY, "html")
    # records are compressed twice, for their sizes and to be written: that costs less than to store them
    sizes = cut(made.mapInArrow(lean(_compress(date, False)), f"{shape}, size bigint"), "warc-sizes")
    records = made.mapInArrow(lean(_compress(date, True)), f"{shape}, payload string, size bigint, record binary")
    order = [(F.coalesce("url", F.lit("")) == "").asc(), F.col("url").asc_nulls_last(), F.col("page_id").asc_nulls_last(), F.col("digest"), F.col("copy")]
    keys = sizes.repartitionByRange(*order).sortWithinPartitions(*order)

    def begin(batches):
        """Where each record begins among those of the task."""
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column(4).to_numpy()
            ends = at + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.full(len(size), part, np.int32)), pa.array(ends - size), pa.array(ends)], names=[*_KEY, "part", "begin", "end"])
            at = int(ends[-1]) if len(size) else at

    sorted_ = cut(keys.mapInArrow(begin, f"{shape}, part int, begin bigint, end bigint"), "warc-order")
    before, starts = 0, {}
    for r in sorted_.groupBy("part").agg(F.max("end").alias("size")).orderBy("part").collect():  # a row for each task
        starts[r["part"]] = before
        before += r["size"]

    def first_of_files(batches):
        """The first records of files, and of each batch."""
        for batch in batches:
            if not len(batch):
                continue
            base = np.array([starts[p] for p in batch.column(4).to_pylist()], np.int64)
            number = (base + batch.column(5).to_numpy()) // file_bytes
            new = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            some = batch.take(pa.array(new))
            yield pa.RecordBatch.from_arrays([pa.array(number[new]), pa.array((base + batch.column(5).to_numpy())[new]), *some.columns[:4]], names=["number", "at", *_KEY])

    heads = sorted_.mapInArrow(first_of_files, f"number bigint, at bigint, {shape}")
    heads = heads.groupBy("number").agg(F.min_by(F.struct(*_KEY), "at").alias("k")).orderBy("number").collect()  # a row for each file
    numbers, places = [r["number"] for r in heads], [_place(*r["k"]) for r in heads]
    shared = spark.sparkContext.broadcast((np.array(numbers, np.int64), places))

    def number(batches):
        """The file of each record."""
        numbers, places = shared.value
        for batch in batches:
            at = [bisect_right(places, _place(*k)) - 1 for k in zip(*(batch.column(c).to_pylist() for c in range(4)))]
            yield pa.RecordBatch.from_arrays([pa.array(numbers[at]) if len(at) else pa.array([], pa.int64()), pa.array(at, pa.int32()), *batch.columns], names=["number", "nth", *batch.schema.names])

    placed = records.mapInArrow(lean(number), f"number bigint, nth int, {shape}, payload string, size bigint, record binary")

    def save(batches):
        task = TaskContext.get()
        mark = f"{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        store, top = _open(path)
        store.create_dir(f"{top}/_temporary", recursive=True)
        now, stream, offset, temporary = None, None, 0, ""
        try:
            for batch in batches:
                if not len(batch):
                    continue
                names, offs, temps = [], [], []
                for n, gz in zip(batch.column(0).to_pylist(), batch.column(4)):
                    if n != now:
                        if stream:
                            stream.close()
                        now, name = n, file_name(n)
                        temporary = f"_temporary/{name}.{mark}"
                        stream = store.open_output_stream(f"{top}/{temporary}", compression=None)
                        head = info_record(name, date)
                        stream.write(head)
                        offset = len(head)
                    stream.write(gz.as_buffer())
                    names.append(file_name(n))
                    offs.append(offset)
                    temps.append(temporary)
                    offset += len(gz.as_buffer())
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(names), pa.array(offs, pa.int64()), batch.column(5), batch.column(3), pa.array(temps)], names=["page_id", "url", "file", "offset", "length", "payload", "temporary"])
        finally:
            if stream:
                stream.close()

    tasks = max(1, len(heads))
    files = placed.repartitionById(tasks, "nth").sortWithinPartitions("number", *order).select("number", "page_id", "url", "payload", "record", "size")
    index = cut(files.mapInArrow(lean(save), f"page_id {id_type}, url string, file string, offset bigint, length bigint, payload string, temporary string"), "warc-index")
    _commit(spark, path, index)
    return index.drop("temporary")


def _commit(spark: SparkSession, path: str, index: DataFrame) -> None:
    def rename(batches):
        """May run again: a file that has its name already was renamed before."""
        store, top = _open(path)
        for batch in batches:
            for name, temporary in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if store.get_file_info(f"{top}/{temporary}").type != pafs.FileType.NotFound:
                    store.move(f"{top}/{temporary}", f"{top}/{name}")
                elif store.get_file_info(f"{top}/{name}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(temporary)
            yield batch.select([0, 1, 2])

    files = index.groupBy("file", "temporary").agg(F.count("*").alias("records"), F.max(F.col("offset") + F.col("length")).alias("bytes")).select("file", "records", "bytes", "temporary")
    draft = f"{path}/_temporary/{MANIFEST}"
    files.mapInArrow(rename, "file string, records bigint, bytes bigint").write.mode("overwrite").parquet(draft)
    fs, root = _open(path)
    fs.move(f"{root}/_temporary/{MANIFEST}", f"{root}/{MANIFEST}")
    drop_path(spark, f"{path}/_temporary")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The committed files of a folder: (file, records, bytes)."""
    return spark.read.parquet(f"{path}/{MANIFEST}")


def op3_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
