"""Language identification with spans.

Letters are cut into words, at changes of script too. The script of a word narrows
its candidates; byte-trigram log-probabilities, learned from labelled rows, score
them; and a Viterbi pass over all words of a text, with a penalty for each switch,
labels spans. The state "und" scores every trigram alike, so it takes what no
language explains. All steps are numpy over many texts at once; the Viterbi steps
run over all texts of a slice together.

Defined results: a null, empty or letterless text is "und" with share 0 and no
spans. Ties go to the language first in the alphabet, "und" last. Texts of any length
are read whole. Rows are labelled one by one, so repeated rows get equal labels.
With no labelled rows, only scripts are told apart, and text in Latin letters or in a script
without a name here is "und".
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, lean, raw_bytes, slices
from .textvec import runs

#: Trigrams are counted in so many buckets.
BITS = 16
#: Labelled rows taken for each language, at most; the least hashes of ids.
SAMPLE_PER_LANGUAGE = 400
#: What a change of language costs, in nats.
SWITCH = 12.0
#: Scores of trigrams that are looked up at a time.
BLOCK = 1 << 20
FAR = np.float32(-1e4)
UND = "und"
#: First code point, last code point, script.
SCRIPTS = [(0x41, 0x24F, "Latin"), (0x1E00, 0x1EFF, "Latin"), (0x370, 0x3FF, "Greek"), (0x1F00, 0x1FFF, "Greek"), (0x400, 0x52F, "Cyrillic"), (0x530, 0x58F, "Armenian"), (0x590, 0x5FF, "Hebrew"), (0x600, 0x77F, "Arabic"), (0x900, 0x97F, "Devanagari"), (0x980, 0x9FF, "Bengali"), (0xA00, 0xA7F, "Gurmukhi"), (0xA80, 0xAFF, "Gujarati"), (0xB00, 0xB7F, "Odia"), (0xB80, 0xBFF, "Tamil"), (0xC00, 0xC7F, "Telugu"), (0xC80, 0xCFF, "Kannada"), (0xD00, 0xD7F, "Malayalam"), (0xD80, 0xDFF, "Sinhala"), (0x780, 0x7BF, "Thaana"), (0xE00, 0xE7F, "Thai"), (0xE80, 0xEFF, "Lao"), (0xF00, 0xFFF, "Tibetan"), (0x1000, 0x109F, "Myanmar"), (0x1200, 0x139F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"), (0x1800, 0x18AF, "Mongolian"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0xAC00, 0xD7AF, "Hangul"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"), (0xF900, 0xFAFF, "Han"), (0x20000, 0x3FFFF, "Han")]
#: Letters of all other scripts; which languages they may be is learned.
OTHER = "Other"
#: Languages of scripts, beside those that are learned.
SCRIPT_LANGUAGES = {"Greek": ["el"], "Cyrillic": ["ru"], "Armenian": ["hy"], "Hebrew": ["he"], "Arabic": ["ar"], "Devanagari": ["hi"], "Bengali": ["bn"], "Gurmukhi": ["pa"], "Gujarati": ["gu"], "Odia": ["or"], "Tamil": ["ta"], "Telugu": ["te"], "Kannada": ["kn"], "Malayalam": ["ml"], "Sinhala": ["si"], "Thaana": ["dv"], "Thai": ["th"], "Lao": ["lo"], "Tibetan": ["bo"], "Myanmar": ["my"], "Ethiopic": ["am"], "Khmer": ["km"], "Mongolian": ["mn"], "Georgian": ["ka"], "Hangul": ["ko"], "Kana": ["ja"], "Han": ["zh", "ja"]}
NAMES = ["none", *dict.fromkeys(s for *_, s in SCRIPTS), OTHER]


#: Marks without a script of their own: they have that of the letter before.
INHERITED = 255


@cache
def _classes() -> np.ndarray:
    """The script of each code point: letters and marks have one, all else has none (0)."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x20000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            table[c] = NAMES.index(OTHER) if kind == "L" else INHERITED
    for first, last, name in SCRIPTS:
        some = table[first : last + 1]
        some[(some > 0) | (first >= 0x20000)] = NAMES.index(name)
    return table


def scripts_of(b: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The script of the character that each byte belongs to; more marks the bytes within characters."""
    table = _classes()
    script = table[b * (b < 128)]
    at = np.flatnonzero(b >= 0xC2)
    if not len(at) and not more.any():
        return script
    wide = np.concatenate([b, np.zeros(3, np.uint8)])
    x = [wide[at + k].astype(np.int64) for k in range(4)]
    y = [v & 0x3F for v in x]
    two, three = (x[0] & 0x1F) << 6 | y[1], (x[0] & 0x0F) << 12 | y[1] << 6 | y[2]
    four = (x[0] & 0x07) << 18 | y[1] << 12 | y[2] << 6 | y[3]
    script[at] = table[np.minimum(np.where(x[0] < 0xE0, two, np.where(x[0] < 0xF0, three, four)), 0x10FFFF)]
    own = ~more & (script != INHERITED)
    first = np.maximum.accumulate(np.where(own, np.arange(len(b)), 0))
    script = script[first]
    return np.where(script == INHERITED, np.uint8(0), script)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STRUCT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
ARROW = pa.struct([("lang", pa.string()), ("share", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])


def _words(data: np.ndarray, off: np.ndarray):
    """Scripts by byte, starts and ends of words, and the trigram buckets at each byte; a byte of space follows each text."""
    n = len(off) - 1
    at = off + np.arange(n + 1)
    own = np.ones(len(data) + n, bool)
    own[at[1:] - 1] = False
    b = np.full(len(own), 32, np.uint8)
    b[own] = data
    more = (b & 0xC0) == 0x80
    script = scripts_of(b, more)
    letter = script > 0
    cuts = at
    if (script > 1).any():
        cuts = np.union1d(at, np.flatnonzero(letter[1:] & letter[:-1] & (script[1:] != script[:-1])) + 1)
    start, end = runs(letter, cuts)
    low = LOWER[b]
    low[1:] += (((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) * 32).astype(np.uint8)
    low[~letter] = 32
    code = low.astype(np.uint32)
    code[1:] |= low[:-1].astype(np.uint32) << 8
    code[2:] |= low[:-2].astype(np.uint32) << 16
    return script, start, end, (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), at, own, more


def _slots(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words and the one after each, and where each word begins among them."""
    size = end - start + 1
    first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
    return np.arange(size.sum()) + np.repeat(start - first, size), first


class Model:
    """Log-probabilities by trigram bucket and state, and the states that each script allows."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray, switch: float = SWITCH):
        self.switch = switch
        extra = sorted({x for s in SCRIPT_LANGUAGES.values() for x in s} - set(languages))
        self.states = [*languages, UND, *extra]
        p = counts + 0.1
        log_p = np.log(p / p.sum(1, keepdims=True)) if len(languages) else np.zeros((0, 1 << BITS))
        self.table = np.ascontiguousarray(np.vstack([log_p, np.full((1, 1 << BITS), -BITS * np.log(2))]).T.astype(np.float32))
        self.allowed = np.zeros((len(NAMES), len(self.states)), bool)
        for s, name in enumerate(NAMES):
            for k, lang in enumerate(self.states):
                learned = k < len(languages) and scripts[k, s] >= 0.01 * max(scripts[k].sum(), 1)
                self.allowed[s, k] = learned or lang == UND or lang in SCRIPT_LANGUAGES.get(name, [])

    def scores(self, script: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words by state, and the states in use."""
        slot, first = _slots(start, end)
        known = np.empty((len(first), self.table.shape[1]), np.float32)
        step, i = max(1, BLOCK // self.table.shape[1]), 0
        while i < len(first):
            # no more than BLOCK scores at a time, but for a longer word
            j = max(i + 1, int(np.searchsorted(first, first[i] + step, "right")) - 1)
            a, z = first[i], first[j] if j < len(first) else len(slot)
            known[i:j] = np.add.reduceat(self.table[code[slot[a:z]]], first[i:j] - a, axis=0)
            i = j
        present = script[start]
        seen = np.unique(present)
        use = np.flatnonzero(self.allowed[seen].any(0)) if len(seen) else np.arange(self.table.shape[1])
        use = np.union1d(use, np.arange(self.table.shape[1]))
        out = np.empty((len(start), len(use)), np.float32)
        out[:, : self.table.shape[1]] = known
        if len(use) > self.table.shape[1]:
            # a state without a model explains a trigram of its script twice as well as "und" does, in log
            out[:, self.table.shape[1] :] = known[:, -1:] / 2
        return np.where(self.allowed[:, use][present], out, FAR), use

    def viterbi(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best state of each word; words of text i are first[i] to first[i + 1]."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        begin, size = first[:-1][order], size[order]
        back = np.empty(score.shape, np.int16)
        steps = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(steps), "left")  # texts with more words than t
        v = score[begin[: alive[0]]].copy() if steps else score[:0]
        last = np.zeros(len(size), np.int64)
        every = np.arange(score.shape[1], dtype=np.int16)
        for t in range(1, steps):
            n = alive[t]
            if n < len(v):
                last[n : len(v)] = v[n:].argmax(1)
                v = v[:n]
            best = v.argmax(1)
            top = v[np.arange(n), best][:, None] - self.switch
            back[begin[:n] + t] = np.where(v >= top, every, best[:, None].astype(np.int16))
            v = np.maximum(v, top) + score[begin[:n] + t]
            v -= v.max(1, keepdims=True)
        if steps:
            last[: len(v)] = v.argmax(1)
        label = np.zeros(len(score), np.int16)
        for t in range(steps - 1, -1, -1):
            n = alive[t]
            at = begin[:n] + t
            label[at] = last[:n]
            last[:n] = back[at, last[:n]] if t else last[:n]
        return label

    def label(self, col: pa.Array) -> pa.Array:
        data, off = raw_bytes(col)
        script, start, end, code, at, own, more = _words(data, off)
        score, use = self.scores(script, start, end, code)
        first = np.searchsorted(start, at)
        label = use[self.viterbi(score, first)]
        n, k = len(col), len(self.states)
        text = np.repeat(np.arange(n), np.diff(first))
        weight = np.bincount(text * k + label, end - start, n * k).reshape(n, k)
        rank = np.array([x for x in np.argsort(self.states) if self.states[x] != UND] + [self.states.index(UND)])
        top = rank[weight[:, rank].argmax(1)]
        total = weight.sum(1)
        top[total == 0] = self.states.index(UND)
        share = np.where(total > 0, weight[np.arange(n), top] / np.maximum(total, 1), 0.0)
        new = np.ones(len(label), bool)
        new[1:] = (label[1:] != label[:-1]) | (text[1:] != text[:-1])
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(label))
        chars = np.concatenate([[0], np.cumsum(own & ~more)])  # spans count characters
        base = chars[at[:-1]][text[a]] if len(a) else np.zeros(0, np.int64)
        names = pa.array(self.states)
        spans = pa.StructArray.from_arrays([names.take(pa.array(label[a].astype(np.int32))), pa.array((chars[start[a]] - base).astype(np.int32)), pa.array((chars[end[z - 1]] - base).astype(np.int32))] if len(a) else [pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.int32())], names=["lang", "start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(a, first).astype(np.int32)), spans)
        return pa.StructArray.from_arrays([names.take(pa.array(top.astype(np.int32))), pa.array(share), lists], names=["lang", "share", "spans"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, switch: float = SWITCH) -> Model:
    """Fits the trigram model on at most per_language labelled rows of each language, the bound of the sample."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.lower(F.trim(F.col(f"`{lang_col}`"))).alias("lang"))
    d = d.where("lang IS NOT NULL AND lang NOT IN ('', 'und')")
    ranked = d.select("id", "lang").where("id IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")))
    chosen = ranked.where(F.col("k") <= per_language).select("id", "lang").distinct()  # its size is bounded, so broadcasting it is safe
    sample = d.where("text IS NOT NULL").join(F.broadcast(chosen), ["id", "lang"], "left_semi").select("lang", "text")

    def count(batches):
        total: dict[str, list] = {}
        for batch in batches:
            for i, j in slices(batch.column(1)):
                langs = batch.column(0)[i:j].to_numpy(zero_copy_only=False)
                data, off = raw_bytes(batch.column(1)[i:j])
                script, start, end, code, at, _, _ = _words(data, off)
                slot, _ = _slots(start, end)
                of_slot = np.searchsorted(at, slot, "right") - 1
                of_word = np.searchsorted(at, start, "right") - 1
                for lang in np.unique(langs):
                    mine = langs == lang
                    c, s = total.setdefault(lang, [np.zeros(1 << BITS), np.zeros(len(NAMES))])
                    c += np.bincount(code[slot[mine[of_slot]]], minlength=1 << BITS)
                    s += np.bincount(script[start[mine[of_word]]], minlength=len(NAMES))
        for lang, (c, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c.tobytes()]), pa.array([s.tobytes()])], names=["lang", "counts", "scripts"])

    found: dict[str, list] = {}
    for r in sample.coalesce(4).mapInArrow(lean(count), "lang string, counts binary, scripts binary").toLocalIterator():
        own = found.setdefault(r.lang, [np.zeros(1 << BITS), np.zeros(len(NAMES))])
        own[0] += np.frombuffer(r.counts)
        own[1] += np.frombuffer(r.scripts)
    langs = sorted(found)
    empty = (np.zeros((0, 1 << BITS)), np.zeros((0, len(NAMES))))
    return Model(langs, *(np.array([found[x][k] for x in langs]) if langs else empty[k] for k in (0, 1)), switch)


def labeller(spark: SparkSession, model: Model):
    """A column function: text to (lang, share, spans)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(STRUCT)
    @lean
    def label(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in cols:
            parts = [shared.value.label(col[i:j]).cast(ARROW) for i, j in slices(col)]
            yield pa.concat_arrays(parts) if parts else pa.array([], ARROW)

    return label


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (doc_id, lang, share, spans), spans holding (lang, start, end) in characters."""
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), labeller(docs.sparkSession, model)(F.col(f"`{text_col}`")).alias("r"))
    return found.select("doc_id", "r.lang", "r.share", "r.spans")


def known_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which most letters are in a known language. A model without languages rejects none."""
    if model.states[0] == UND:
        return docs
    v = free_name(docs, "verdict_")
    rows = docs.withColumn(v, labeller(docs.sparkSession, model)(F.col(f"`{text_col}`"))["lang"])
    return rows.where(F.col(v) != UND).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
