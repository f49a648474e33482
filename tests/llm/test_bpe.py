import random

import pytest

from skeinwork.llm import bpe, tokenfile


@pytest.fixture(scope="module")
def shared(spark):
    return bpe.vocabulary(spark)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    texts = [None, "", "abc", " ", "\n\n", "naïve ça — 漢字 😀 it's we'll  \n\n x<|endoftext|>", "a" * 5000, " " * 5000 + "x", "'ll" * 900, "".join(r.choice(["a", "b", " ", "'ll", "\n", "1", "é", "漢", "!"]) for _ in range(9000))]
    texts += ["".join(r.choice("ab  '\n1!lsé") for _ in range(r.randrange(300, 3000))) for _ in range(20)] + ["abc", "abc"]
    return spark.createDataFrame([(k if k else None, t, "x", "y") for k, t in enumerate(texts)], "doc_id bigint, text string, uid string, ids string")


@pytest.mark.parametrize("chunk,overlap", [(100, 8), (64, 2), (1000, 100), (1 << 15, 256)])
def test_stitched_ids_are_those_of_the_whole_text(docs, shared, chunk, overlap):
    b = bpe.loaded(shared)
    packed = bpe.encoded(docs, shared, chunk=chunk, overlap=overlap)
    got = {r.doc_id: r for r in bpe.unpack(packed, shared).collect()}
    back = {r.doc_id: r.bytes for r in bpe.decoded(packed, shared).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        if r.text is None:
            assert g.ids is None and g.n_tokens is None and back[r.doc_id] is None
            continue
        assert g.ids == ([int(x) for x in b.encode(r.text)] if r.text else [])
        assert g.n_tokens == len(g.ids) and g.n_bytes == len(r.text.encode())
        assert back[r.doc_id].decode() == r.text


def test_same_ids_as_a_public_encoder(docs, shared):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    e = tiktoken.Encoding("x", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in bpe.unpack(bpe.encoded(docs, shared, chunk=500, overlap=16), shared).collect()}
    assert all(got[r.doc_id] == e.encode_ordinary(r.text) for r in docs.collect() if r.text is not None)


def test_empty_and_wrong_ids(spark, shared):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.unpack(bpe.encoded(none, shared), shared).collect() == []
    wrong = spark.createDataFrame([(1, b"\xff\xff"), (2, b"\x01"), (3, None), (4, b"")], "doc_id bigint, ids binary")
    assert {r.doc_id: r.bytes for r in bpe.decoded(wrong, shared).collect()} == {1: None, 2: None, 3: None, 4: b""}


def test_query_reads_every_document(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = bpe.op4_byte_bpe(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs) and all(r.n_bytes == len(docs[r.doc_id].encode()) for r in rows)


def test_query_decodes_what_it_encoded(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r.doc_id: r.text for r in bpe.op4_byte_bpe(spark, small).collect()} == docs


def test_a_long_pre_token_leaves_the_text_behind_it_parallel(spark, shared):
    r = random.Random(2)
    words = lambda n: "".join(r.choice(["ab ", "it's ", "1 ", "\n", "!", "é"]) for _ in range(n))
    texts = [words(500) + "a" * 1000 + words(2000) + " " * 700 + words(2000), "x" * 3000, words(3000)]
    rows = bpe._pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), shared, 100, 8).collect()
    b = bpe.loaded(shared)
    for k, text in enumerate(texts):
        own = [x.text for x in sorted((x for x in rows if x.doc_id == k), key=lambda x: x.piece)]
        assert "".join(own) == text and [i for x in own for i in b.encode(x)] == list(b.encode(text))
        # a piece is a few chunks, but for the long pre-token in it
        assert max(len(x.replace("a" * 1000, "").replace(" " * 699, "").replace("x" * 3000, "")) for x in own) < 500


def test_token_file_round_trip(spark, docs, shared):
    packed = bpe.encoded(docs, shared).cache()
    ranks = tokenfile.rank_table(packed).cache()
    coded = tokenfile.write(packed, ranks)
    assert {r.doc_id: r.ids for r in tokenfile.read(coded, ranks).collect()} == {r.doc_id: r.ids for r in packed.collect()}
    from collections import Counter

    import numpy as np

    counts = Counter(int(x) for r in packed.collect() if r.ids for x in np.frombuffer(r.ids, np.uint16))
    assert [(r.id, r.n) for r in ranks.orderBy("rank").collect()] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    for r in coded.collect():
        assert (r.n_tokens is None) == (r.control is None) == (r.data is None)
        assert r.control is None or len(r.control) == -(-r.n_tokens // 4)
    with pytest.raises(Exception, match="no rank"):
        tokenfile.write(packed, ranks.where("rank > 3")).collect()


def test_token_file_codes_all_lengths():
    import numpy as np

    x = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    bounds = np.array([0, 0, 5, 5, 8])
    control, cb, data, _ = tokenfile.code(x, bounds)
    assert list(tokenfile.decode(control, cb, np.diff(bounds), data)) == list(x)
    assert len(data) == 1 + 1 + 2 + 2 + 3 + 4 + 4 + 1


def test_token_file_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, ids binary")
    ranks = tokenfile.rank_table(none)
    assert ranks.collect() == [] and tokenfile.write(none, ranks).collect() == []


def test_token_file_query(spark, small, shared):
    rows = tokenfile.op10_token_output(spark, small).collect()
    n = {r.doc_id: r.n_tokens for r in bpe.op4_byte_bpe(spark, small).collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == n
