import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import langid
from skeinwork.llm.shared import release


@pytest.fixture(scope="module")
def docs(spark, medium):
    return spark.read.parquet(f"{medium}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langid.train(docs.where("doc_id % 2 = 0"))


def test_held_out_accuracy(docs, model):
    truth = {r.doc_id: r.lang for r in docs.where("doc_id % 2 = 1 AND length(text) > 50").collect()}
    got = {r.doc_id: r.lang for r in langid.identify(docs.where("doc_id % 2 = 1"), model).collect()}
    wrong = [k for k, lang in truth.items() if got[k] != lang]
    assert len(wrong) <= 0.03 * len(truth)


def test_viterbi_is_exact(model):
    rng = np.random.default_rng(0)
    score = rng.normal(size=(40, 3)).astype(np.float32) * 8
    first = np.array([0, 7, 7, 8, 40])
    got = model.viterbi(score, first)
    for a, z in zip(first[:-1], first[1:]):
        if z == a:
            continue
        v, back = score[a].astype(np.float64), []
        for t in range(a + 1, z):
            move = v[None, :] - model.switch * (1 - np.eye(3))
            back.append(move.argmax(1))
            v = move.max(1) + score[t]
        total = lambda p: sum(score[a + i, k] for i, k in enumerate(p)) - model.switch * sum(x != y for x, y in zip(p, p[1:]))
        assert abs(total(got[a:z]) - v.max()) < 1e-2


def test_spans_of_mixed_text(docs, model):
    by = {lang: " ".join(r.text for r in docs.where(f"lang = '{lang}' AND length(text) > 300").orderBy("doc_id").limit(3).collect())[:400].rsplit(" ", 1)[0] for lang in ("en", "de", "fr")}
    text = by["en"] + " " + by["de"] + " Привет мир " + by["fr"]
    r = model.label(pa.array([text]))[0].as_py()
    runs = [s["lang"] for s in r["spans"] if s["end"] - s["start"] > 8]
    assert [x for k, x in enumerate(runs) if not k or x != runs[k - 1]] == ["en", "de", "ru", "fr"]
    near = lambda a, b: abs(a - b) < 40
    de = next(s for s in r["spans"] if s["lang"] == "de" and s["end"] - s["start"] > 100)
    assert near(de["start"], len(by["en"])) and near(de["end"], len(by["en"]) + len(by["de"]))
    ru = next(s for s in r["spans"] if s["lang"] == "ru")
    assert text[ru["start"] :].startswith("Привет")


def test_odd_texts(spark, model):
    texts = [None, "", "123 !!! \n", "漢字", "x" * 200_000, "the and " * 50_000, "ελληνικά", "a"]
    df = spark.createDataFrame([(k if k else None, t, "zz", "q") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, spans string")
    got = {r.doc_id: r for r in langid.identify(df.unionByName(df), model).collect()}
    assert len(got) == len(texts)
    for k in (None, 1, 2):
        assert (got[k].lang, got[k].share, got[k].spans) == ("und", 0.0, [])
    assert got[6].lang == "el" and got[3].lang in ("zh", "ja")
    assert langid.identify(df.limit(0), model).collect() == []
    kept = langid.known_language(df, model)
    assert kept.columns == df.columns and {None, 1, 2}.isdisjoint({r.doc_id for r in kept.collect()})


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "Привет", None), (3, None, None)], "doc_id bigint, text string, lang string")
    m = langid.train(df)
    assert {r.doc_id: r.lang for r in langid.identify(df, m).collect()} == {1: "und", 2: "ru", 3: "und"}
    assert langid.known_language(df, m).count() == 3


def test_labelled_rows_of_every_script_are_kept(spark, docs):
    texts = {"te": "తెలుగు భాష చాలా అందమైనది మరియు పురాతనమైనది", "gu": "ગુજરાતી ભાષા ખૂબ સુંદર છે", "chr": "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ ᎠᏂᏴᏫ", "km": "ភាសាខ្មែរ ជាភាសា", "am": "አማርኛ ቋንቋ ነው"}
    rows = [(10**6 + 20 * k + i, text + f" {i}", lang) for k, (lang, text) in enumerate(texts.items()) for i in range(20)]
    df = docs.select("doc_id", "text", "lang").limit(50).unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    model = langid.train(df)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert all(got[d].lang == lang and got[d].share == 1.0 and got[d].spans for d, _, lang in rows)
    assert {d for d, *_ in rows} <= {r.doc_id for r in langid.known_language(df, model).collect()}
    unlabelled = langid.train(docs.limit(50)).label(pa.array([texts["te"], texts["km"]])).to_pylist()
    assert [r["lang"] for r in unlabelled] == ["te", "km"]


def test_many_languages(spark):
    """More states than a byte counts: each of 200 languages with words of its own is known."""
    rng = np.random.default_rng(1)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)] for _ in range(200)]
    rows = [(k, " ".join(rng.permutation(words[k])), f"l{k:03d}") for k in range(200)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert [r["lang"] for r in model.label(pa.array([t for _, t, _ in rows])).to_pylist()] == [x for *_, x in rows]


def test_ties_go_to_the_first_in_the_alphabet(spark):
    rows = [(1, "mi fa sol", "zz"), (2, "mi fa sol", "aa"), (3, "do re", "und")]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.label(pa.array(["sol fa mi"]))[0].as_py()["lang"] == "aa"


def test_scripts_by_code_point():
    def scripts(text):
        b = np.frombuffer(text.encode(), np.uint8)
        more = (b & 0xC0) == 0x80
        return [langid.NAMES[k] for k in langid.scripts_of(b, more)[~more]]

    # Myanmar and Georgian share their first two bytes in UTF-8
    assert scripts("\u1081\u10a0") == ["Myanmar", "Georgian"]
    assert scripts("e\u0301 \u0301\u0416\u0301!") == ["Latin", "Latin", "none", "none", "Cyrillic", "Cyrillic", "none"]
    assert scripts("\u0967\u0915\u0964") == ["none", "Devanagari", "none"]  # a digit, a letter, a full stop
    assert scripts("\U00020000\U0001F600") == ["Han", "none"]


def test_scores_don_t_depend_on_blocks(model, monkeypatch):
    texts = pa.array(["the cat and the dog " * 50, "x" * 5000, "der Hund und die Katze", "", None])
    whole = model.label(texts)
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert model.label(texts) == whole


def test_workers_give_memory_back(spark, docs, model):
    """Python workers outlive their tasks: after labelling, hardly anything is left that they could give back."""

    def held(batches):
        anon = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024
        time.sleep(0.1 + 0 * sum(len(b) for b in batches))  # so that all idle workers get a task
        before = anon()
        release()
        yield pa.RecordBatch.from_arrays([pa.array([before - anon()], pa.int32())], names=["mb"])

    workers = spark.range(0, 16, 1, 16).mapInArrow(held, "mb int")
    workers.collect()  # what earlier tests have left
    texts = docs.crossJoin(spark.range(8).select(F.col("id").alias("copy"))).repartition(4)
    assert langid.identify(texts, model).where("lang IS NOT NULL").count() == 8 * docs.count()
    assert max(r.mb for r in workers.collect()) < 6


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = langid.op5_language_id(spark, small).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert sum(r.lang == truth[r.doc_id] for r in rows) >= 0.9 * len(rows)
