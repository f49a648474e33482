"""Tokens, headings and other text functions.

Character classes are written out, since regular expressions of Java, RE2 and Python
differ in what a word character is. Null texts give nulls. tokens() brings texts into
NFKC first, so that ligatures and full-width letters are plain ones.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import by_slices
from .patterns import MARKS, RULE
from .vocabulary import LOW_SIGNAL, NOISE_TOKENS, SHORT_TOKENS, STOPWORDS

WORD = r"[\p{L}\p{Nl}\p{No}][\p{L}\p{N}_-]*"
ROMAN = "^[ivxlcdm]+$"
DIGITS = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$"
#: White space as Python's strip() sees it.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
def _unchanged() -> str:
    """A class of characters of which no text is changed by NFKC: those of Latin, Greek and Cyrillic letters, dashes and quotes, kana and Han that stay what they are and don't combine."""
    stays = lambda c: unicodedata.normalize("NFKC", chr(c)) == chr(c) and unicodedata.category(chr(c))[0] != "M"
    some = [c for first, last in ((0, 0x52F), (0x2010, 0x201F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF)) for c in range(first, last + 1) if stays(c)]
    begin = [c for k, c in enumerate(some) if not k or some[k - 1] != c - 1]
    end = [c for k, c in enumerate(some) if k + 1 == len(some) or some[k + 1] != c + 1]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in zip(begin, end)) + "]"


#: ASCII is told first, and by one comparison: each character of other scripts runs through all ranges.
CHANGED = r"[\x{80}-\x{10ffff}&&[^" + _unchanged()[1:] + "]"


def nfkc(text: Column) -> Column:
    """text in NFKC. Only texts that it may change leave the JVM."""

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return by_slices(lambda some: [x if x is None else unicodedata.normalize("NFKC", x) for x in some], pa.string(), col)

    return F.coalesce(run(F.when(text.rlike(CHANGED), text)), text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def lines(text: Column) -> Column:
    """Lines, at every character that ends one in Python."""
    return F.split(F.regexp_replace(text, "\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n"), "\n")


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def is_token(x: Column) -> Column:
    return (F.length(x) >= 3) & ~x.isin(STOPWORDS) & ~x.rlike(ROMAN) & ~x.rlike(DIGITS)


def tokens(text: Column) -> Column:
    """Content words, in order, with repeats."""
    return F.filter(find_all(F.lower(nfkc(text)), WORD), is_token)


def dedupe(values: Column) -> Column:
    """First occurrences, without empty values."""
    return F.array_distinct(F.filter(values, lambda x: x != ""))


def keywords(*texts: Column, limit: int = 8) -> Column:
    """The first distinct tokens of several texts."""
    return F.slice(F.array_distinct(F.concat(*[F.coalesce(tokens(t), F.array().cast("array<string>")) for t in texts])), 1, limit)


def heading_text(heading: Column) -> Column:
    """A heading without its marks."""
    return strip(F.regexp_replace(heading, "^#+", ""))


def heading_samples(headings: Column, limit: int = 4) -> Column:
    return F.transform(F.slice(headings, 1, limit), heading_text)


def fallback_samples(chunk_headings: Column, limit: int = 4) -> Column:
    """Samples for a document without headings, from those of its chunks."""
    clean = F.filter(F.transform(chunk_headings, strip), lambda h: (h != "") & (h != "```") & ~h.startswith("[!["))
    return F.slice(F.array_distinct(clean), 1, limit)


ATX = rf"(?md)^{MARKS}\s+(.+)$"
SETEXT = rf"(?md)^(.+)\n{RULE}\s*$"


def chunk_heading(chunk: Column, fallback: Column) -> Column:
    first = F.try_element_at(F.filter(F.transform(lines(chunk), strip), lambda x: x != ""), F.lit(1))
    marked = F.when(chunk.rlike(ATX), F.regexp_extract(chunk, ATX, 1)).when(chunk.rlike(SETEXT), F.regexp_extract(chunk, SETEXT, 1))
    return F.coalesce(strip(marked), F.substring(first, 1, 80), fallback)


def chunk_preview(chunk: Column, fallback: Column) -> Column:
    said = F.filter(F.transform(lines(chunk), strip), lambda x: (x != "") & ~x.startswith("#"))
    return F.substring(F.coalesce(F.try_element_at(said, F.lit(1)), fallback), 1, 160)


def low_signal(text: Column) -> Column:
    """Whether a text is boilerplate."""
    low = F.lower(text)
    # few texts hold a term at all, and contains() is quick
    hits = sum((low.contains(t) & low.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){t}($|[^\p{{L}}\p{{N}}_])")).cast("int") for t in LOW_SIGNAL)
    return low.contains("project gutenberg") | (hits >= 4)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_aliases(*paths: Column) -> Column:
    return dedupe(F.array(*[x for p in paths for x in (F.coalesce(p, F.lit("")), F.coalesce(base_name(p), F.lit("")))]))


def chunk_path(full_path: Column, index: Column) -> Column:
    """docs/full/DIR/STEM.md to docs/chunks/DIR/STEM_NNN.md."""
    stem = F.regexp_replace(F.regexp_replace(full_path, "^docs/full/", "docs/chunks/"), r"[.][^./]*$", "")
    return F.concat(stem, F.lit("_"), F.when(index < 1000, F.lpad(index.cast("string"), 3, "0")).otherwise(index.cast("string")), F.lit(".md"))


#: The estimator's name, as it stands in the column encoding.
ESTIMATE = "words_and_marks"


def estimate_tokens(text: Column) -> Column:
    """How many words and single marks a text has: an estimate of its tokens that needs no vocabulary."""
    return F.size(find_all(text, r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\x0b]"))


def stem(x: Column) -> Column:
    """A light stemmer; the first rule that fits counts."""
    n = F.length(x)
    cut = lambda k: F.substring(x, F.lit(1), n - k)
    root = cut(3)
    twice = F.substring(root, -1, 1) == F.substring(root, F.length(root) - 1, F.lit(1))
    ing = F.when(twice, F.substring(root, F.lit(1), F.length(root) - 1)).when(root.rlike("(ach|at|iz|ov)$"), F.concat(root, F.lit("e"))).otherwise(root)
    return F.when(x.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y"))).when(x.endswith("ing") & (n > 6), ing).when(x.endswith("ed") & (n > 5), cut(2)).when(x.endswith("es") & (n > 5), cut(2)).when(x.endswith("s") & (n > 4), cut(1)).otherwise(x)


def is_fragment(x: Column) -> Column:
    word = x.rlike(f"^(?:{WORD})$") & is_token(x)
    return (x != "") & ~x.isin(NOISE_TOKENS) & F.when(x.rlike(r"^\p{Nd}+$"), F.length(x) >= 2).otherwise(x.isin(SHORT_TOKENS) | word)


def search_tokens(text: Column) -> Column:
    """Stemmed tokens, and the parts of those that hold hyphens or digits."""
    raw = F.filter(find_all(F.lower(text), r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"), lambda x: x.rlike(r"[-\p{Nd}]"))
    parts = F.flatten(F.transform(raw, lambda x: find_all(x, r"[\p{L}\p{Nl}\p{No}]+|\p{Nd}+")))
    return F.concat(F.transform(tokens(text), stem), F.filter(F.transform(parts, stem), is_fragment))
