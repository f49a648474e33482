"""Byte-level BPE encoding and decoding with a public vocabulary.

A text of up to CHUNK characters is one chunk. A longer one is cut into chunks that
overlap their neighbours by OVERLAP characters on both sides. Each chunk is
pre-tokenised by itself, in parallel. A boundary between pre-tokens that both
neighbours see is where they resynchronise: the pattern looks only ahead, so from
there on both cut alike, and the text is cut there. Chunks that share none with their
predecessor (a pre-token is longer than the overlap) are joined to it and pre-tokenised
anew as one chunk, until all neighbours share one: so only the chunks that such a
pre-token covers are one piece, and the text behind it is parallel again. The pieces are
encoded in parallel and their ids joined. Decoding gathers the bytes of the ids and joins
them; the query decodes what it encoded.

Defined results: a null text has null ids, an empty text none. White space and case
are kept; decoding gives back the bytes. Bytes that aren't UTF-8 are read as U+FFFD.
Strings of special tokens are ordinary text. Rows are encoded one by one, so repeated
rows get equal ids. Extra columns take no part. Decoding ids of which one is null or
not in the vocabulary gives null.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SLICE_BYTES, binary_array, cut, raw_bytes, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a chunk, without its overlaps.
CHUNK = 1 << 15
OVERLAP = 256
#: Characters behind a boundary on which it may depend.
AHEAD = 4
_loaded: dict[str, "Bpe"] = {}


class Bpe:
    """A vocabulary, given as the bytes of a file of base64 tokens and ranks."""

    def __init__(self, source: bytes, pattern: str = PATTERN):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source.splitlines()) if a}
        self.pattern = regex.compile(pattern)
        self.core = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.size = max(ranks.values()) + 1
        length = np.zeros(self.size, np.int64)
        for token, k in ranks.items():
            length[k] = len(token)
        self.length = length
        self.first = np.cumsum(length) - length
        self.bytes = np.zeros(int(length.sum()), np.uint8)
        for token, k in ranks.items():
            self.bytes[self.first[k] : self.first[k] + len(token)] = np.frombuffer(token, np.uint8)

    @property
    def kind(self) -> type:
        """Integers that hold any id."""
        return np.uint16 if self.size <= 1 << 16 else np.uint32

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(memoryview(self.core.encode_to_tiktoken_buffer(text, set())), np.uint32)

    def boundaries(self, text: str) -> np.ndarray:
        """Where pre-tokens end."""
        return np.fromiter((m.end() for m in self.pattern.finditer(text)), np.int64)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of many lists of ids, and their bounds; all ids must be in the vocabulary."""
        size = self.length[ids]
        end = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(end[-1]) + np.repeat(self.first[ids] - end[:-1], size)
        return self.bytes[at], end[bounds]


def vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """The vocabulary's file, sent to all executors; a vocabulary doesn't grow with the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def loaded(shared) -> Bpe:
    """The vocabulary in this process, built once."""
    key = hashlib.sha256(shared.value).hexdigest()
    if key not in _loaded:
        _loaded[key] = Bpe(shared.value)
    return _loaded[key]


def texts_of(col: pa.Array) -> list[str | None]:
    return [None if x is None else x.decode("utf-8", "replace") for x in col.cast(pa.binary()).to_pylist()]


def _packed(bpe: Bpe, texts: list[str | None]) -> pa.Array:
    """The ids of texts as bytes."""
    ids = [bpe.encode(t) if t else np.zeros(0, np.uint32) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) * np.dtype(bpe.kind).itemsize
    values = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    return binary_array(values.astype(bpe.kind).view(np.uint8), bounds, np.array([t is None for t in texts], bool))


def _cuts(text: str, chunk: int, overlap: int):
    """(first character, text) of the chunks with their overlaps."""
    for k in range(max(1, -(-len(text) // chunk))):
        a = max(0, k * chunk - overlap)
        yield k, a, text[a : (k + 1) * chunk + overlap]


def _pieces(long: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """long (doc_id, text) to the pieces (uid, doc_id, piece, text) that are encoded apart: those of a uid, in order, are a text, cut where pre-tokens end."""
    id_type = long.schema["doc_id"].dataType.simpleString()

    def chunks(batches):
        for batch in batches:
            for r in range(len(batch)):
                parts = list(_cuts(texts_of(batch.column(2)[r : r + 1])[0], chunk, overlap))
                for i in range(0, len(parts), 64):
                    some = parts[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(c)[r : r + 1]] * len(some)) for c in (0, 1)] + [pa.array([p[0] for p in some], pa.int32()), pa.array([p[1] for p in some], pa.int64()), pa.array([p[2] for p in some], pa.string())], names=["uid", "doc_id", "k", "first", "text"])

    def zones(batches):
        """Boundaries in the overlaps with the chunks before and after those from k to last; none that may depend on what lies behind them."""
        bpe = loaded(shared)
        for batch in batches:
            before, after = [], []
            for k, last, a, text in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), texts_of(batch.column(4))):
                at = bpe.boundaries(text)
                at = at[at + AHEAD <= len(text)] + a
                before.append(at[abs(at - k * chunk) <= overlap])
                after.append(at[abs(at - (last + 1) * chunk) <= overlap])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(before, pa.list_(pa.int64())), pa.array(after, pa.list_(pa.int64()))], names=["uid", "k", "last", "before", "after"])

    def spans(batches):
        """The text from a to z of each chunk."""
        for batch in batches:
            first, a, z = (batch.column(c).to_pylist() for c in (3, 5, 6))
            texts = [t[x - f : None if y is None else y - f] for t, f, x, y in zip(texts_of(batch.column(4)), first, a, z)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(7), batch.column(2), pa.array(texts, pa.string())], names=["uid", "doc_id", "piece", "k", "text"])

    shape, joined = f"uid bigint, doc_id {id_type}, piece int, k int, text string", F.expr("listagg(text, '') WITHIN GROUP (ORDER BY k)").alias("text")
    zoned = "uid bigint, k int, last int, before array<bigint>, after array<bigint>"
    cutup = cut(long.withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "text").mapInArrow(chunks, f"uid bigint, doc_id {id_type}, k int, first bigint, text string").repartition("uid", "k"), "chunks")
    w = Window.partitionBy("uid").orderBy("k")
    now = cutup.select("uid", "k", F.col("k").alias("last"), "first", "text").mapInArrow(zones, zoned)
    while True:
        sync = now.withColumn("at", F.array_min(F.array_intersect("before", F.lag("after").over(w))))
        sync = cut(sync.withColumn("head", F.max(F.when(F.col("at").isNotNull() | (F.col("k") == 0), F.col("k"))).over(w)), "boundaries")
        apart = sync.where("k <> head")
        if apart.isEmpty():
            break
        groups = sync.join(apart.select("uid", "head").distinct(), ["uid", "head"], "left_semi").groupBy("uid", "head").agg(F.max("last").alias("last"))
        members = cutup.join(groups.withColumn("k", F.explode(F.sequence("head", "last"))), ["uid", "k"])
        core = lambda k: (F.col(k) * F.lit(chunk).cast("long"))
        a = F.when(F.col("k") == F.col("head"), F.col("first")).otherwise(core("k"))
        z = F.when(F.col("k") < F.col("last"), core("k") + chunk)
        glued = members.select("uid", "doc_id", "k", "first", "text", a.alias("a"), z.alias("z"), F.col("head").alias("piece")).mapInArrow(spans, shape).groupBy("uid", "piece").agg(joined)
        start = F.greatest(F.lit(0).cast("long"), core("head") - overlap)
        again = glued.withColumnRenamed("piece", "head").join(groups, ["uid", "head"]).select("uid", F.col("head").alias("k"), "last", start.alias("first"), "text").mapInArrow(zones, zoned)
        now = sync.join(groups.select("uid", "head"), ["uid", "head"], "left_anti").select("uid", "k", "last", "before", "after").unionByName(again)
    begin = sync.select("uid", F.col("k").alias("piece"), F.coalesce("at", F.lit(0).cast("long")).alias("at"), F.explode(F.sequence("k", "last")).alias("k"), (F.col("last") > F.col("k")).alias("together"))
    edges = begin.withColumn("a", F.when(F.col("k") == F.col("piece"), F.col("at")).otherwise(F.col("k") * F.lit(chunk).cast("long"))).drop("at").withColumn("z", F.lead("a").over(w))
    part = cutup.join(edges, ["uid", "k"]).select("uid", "doc_id", "k", "first", "text", "a", "z", "piece", "together")
    alone = part.where("NOT together").mapInArrow(spans, shape).drop("k")
    return alone.unionByName(part.where("together").mapInArrow(spans, shape).groupBy("uid", "doc_id", "piece").agg(joined))


def encoded(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each row of docs: (doc_id, ids), the ids being packed as unsigned integers of two bytes, or of four where the vocabulary needs them."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    long = F.length("text") > chunk

    def whole(batches):
        bpe = loaded(shared)
        for batch in batches:
            for i, j in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], _packed(bpe, texts_of(batch.column(1)[i:j]))], names=["doc_id", "ids"])

    def encode_pieces(batches):
        bpe = loaded(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _packed(bpe, texts_of(batch.column(3)))], names=["uid", "doc_id", "piece", "ids"])

    short = own.where(~F.coalesce(long, F.lit(False))).mapInArrow(whole, f"doc_id {id_type}, ids binary")
    done = _pieces(own.where(long), shared, chunk, overlap).mapInArrow(encode_pieces, f"uid bigint, doc_id {id_type}, piece int, ids binary")
    joined = done.groupBy("uid", "doc_id").agg(F.expr("listagg(ids, X'') WITHIN GROUP (ORDER BY piece)").alias("ids"))
    return short.unionByName(joined.select("doc_id", "ids"))


def decoded(rows: DataFrame, shared, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """rows (doc_id, packed ids) to (doc_id, bytes)."""
    own = rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches):
        bpe = loaded(shared)
        for batch in batches:
            for i, j in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], decode_packed(bpe, batch.column(1)[i:j])], names=["doc_id", "bytes"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, bytes binary")


def decode_packed(bpe: Bpe, col: pa.Array) -> pa.Array:
    data, off = raw_bytes(col)
    step = np.dtype(bpe.kind).itemsize
    ids, bounds = np.frombuffer(data[: len(data) // step * step].tobytes(), bpe.kind).astype(np.int64), off // step
    known = (ids < bpe.size) & (bpe.length[np.minimum(ids, bpe.size - 1)] > 0)
    bad = np.concatenate([[0], np.cumsum(~known)])
    none = np.asarray(col.is_null()) | (bad[bounds[1:]] > bad[bounds[:-1]]) | (off[1:] % step > 0) | (off[:-1] % step > 0)
    out, ends = bpe.decode(np.where(known, ids, np.flatnonzero(bpe.length)[0]), bounds)
    return binary_array(out, ends, none)


def unpack(rows: DataFrame, shared) -> DataFrame:
    """rows (doc_id, packed ids) to (doc_id, n_tokens, n_bytes, ids, text): ids as integers, and the text that they decode to, which has n_bytes."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = loaded(shared)
        for batch in batches:
            for i, j in slices(batch.column(1), SLICE_BYTES):
                col = batch.column(1)[i:j]
                data, off = raw_bytes(col)
                ids, bounds, none = np.frombuffer(data.tobytes(), bpe.kind), off // np.dtype(bpe.kind).itemsize, np.asarray(col.is_null())
                back = decode_packed(bpe, col)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=np.append(none, False)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(bounds), mask=none), pc.binary_length(back).cast(pa.int64()), lists, back], names=["doc_id", "n_tokens", "n_bytes", "ids", "bytes"])

    found = rows.mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, n_bytes bigint, ids array<int>, bytes binary")
    return found.select("doc_id", "n_tokens", "n_bytes", "ids", F.col("bytes").cast("string").alias("text"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and the text that they decode to."""
    docs, shared = spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(spark)
    return unpack(encoded(docs, shared), shared)
