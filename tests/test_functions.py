import unicodedata

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import markdown as M
from skeinwork.functions import pdf as P
from skeinwork.functions import references as R
from skeinwork.functions import text as T
from skeinwork.operators import chunking, lexical, retrieval
from skeinwork.sources import pdf


@pytest.fixture
def value(spark):
    def get(column, text):
        return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("v")).first().v

    return get


def test_tokens(value):
    assert value(T.tokens, "The Quick-fix of CIVIL law, naïve_x 12ab ab mix Überfluß the x") == ["quick-fix", "law", "naïve_x", "überfluß"]
    assert value(T.tokens, None) is None and value(T.tokens, "") == []
    assert value(T.tokens, "ﬁnance Ｔｏｋｅｎｓ cafe\u0301 ①②③ naïve") == ["finance", "tokens", "café", "naïve"]
    assert value(lambda x: T.keywords(x, F.lit("alpha beta"), limit=3), "beta gamma beta") == ["beta", "gamma", "alpha"]


def test_nfkc_is_that_of_python(spark):
    """Characters that NFKC changes, alone and between others, and those that it leaves alone."""
    texts = [chr(c) for c in (*range(1, 0xD800, 7), *range(0xF900, 0xFFFF, 3), *range(0x1D400, 0x1D500))]
    texts = ["", None, "a" + "\u0301", "\u1112\u1161\u11ab", *("".join(texts[k : k + 5]) for k in range(0, len(texts), 5)), *texts]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.nfkc(F.col("t")).alias("t")).collect()
    assert all(r.t == (texts[r.k] and unicodedata.normalize("NFKC", texts[r.k])) for r in got)


def test_terms_are_normalised_everywhere(spark):
    """Ligatures and full-width letters are plain ones in term counts and in retrieval."""
    nodes = spark.createDataFrame([(1, "ﬁnance ﬁnance", None), (2, "finance Ｔｏｋｅｎｓ", None)], "key int, body string, grp string")
    assert sorted((r.key, r.term, r.n) for r in lexical.term_frequency(nodes).collect()) == [(1, "finance", 2), (2, "finance", 1), (2, "tokens", 1)]
    chunks = spark.createDataFrame([("p", "d", "t", "s", "h", "v", "the ﬁnance ｒｕｌｅｓ")], "path string, full_path string, title string, original_source string, heading string, preview string, content string")
    q = spark.createDataFrame([(1, "finance rules")], "query_id int, query string")
    assert [r.key for r in retrieval.best_chunks(chunks, q, 3).collect()] == ["p"]


def test_both_copies_of_the_pdf_repair_agree(spark):
    """sources.pdf repairs one file's text; functions.pdf does for columns."""
    texts = ["T\nhe ﬁrst\nhead\nbody", "```md\n# A\nhead\n```", "x\nTable of Contents\n1 Alpha ..... 3\n2.1 Beta 14\n\n# Real\n" + "prose and more prose here, enough of it.\n" * 2, "", " \n", "A\nB\nhead", "# H\n\n" + "long " * 400]
    for text in texts:
        for gone in (set(), {"head"}):
            df = spark.createDataFrame([(text, sorted(gone))], "x string, gone array<string>")
            assert df.select(P.repaired(F.col("x"), F.col("gone")).alias("v")).first().v == pdf.repair(text, gone)
    for markdown in texts:
        for plain in texts:
            df = spark.createDataFrame([(markdown, plain)], "m string, p string")
            assert df.select(P.prefer_plain(F.col("m"), F.col("p")).alias("v")).first().v == pdf.prefer_plain(markdown, plain, chunking.estimate), (markdown, plain)


@pytest.mark.parametrize("word,stem", [("policies", "policy"), ("running", "run"), ("creating", "create"), ("reaching", "reache"), ("reading", "read"), ("wanted", "want"), ("boxes", "boxe"), ("classes", "class"), ("cars", "cars"), ("trucks", "truck"), ("ties", "ties")])
def test_stem(value, word, stem):
    assert value(T.stem, word) == stem


def test_search_tokens(value):
    assert value(T.search_tokens, "HTTP-9110 uk-ai doc1") == ["http-9110", "uk-ai", "doc1", "http", "9110", "uk", "ai"]


def test_headings(value):
    assert value(M.headings, "# A “b”\ntext\nTop\n===\nSub\n---\n\n## C\n---\n") == ['# A "b"', "# Top", "## Sub", "## C", "## ## C"]
    assert value(lambda x: T.chunk_heading(x, F.lit("f")), "intro\n## H one \nz") == "H one"
    assert value(lambda x: T.chunk_heading(x, F.lit("f")), "\n\n") == "f"
    assert value(lambda x: T.chunk_heading(x, F.lit("f")), " first line\nmore") == "first line"
    assert value(lambda x: T.chunk_preview(x, F.lit("f")), "# H\n\n  body  \n") == "body"
    assert value(lambda x: T.fallback_samples(F.array(x, F.lit("```"), F.lit("[![b"), F.lit(""), x, F.lit("z"))), "q") == ["q", "z"]


def test_documents(value):
    d = value(lambda x: M.markdown_document(x, F.lit("stem")), "---\na: 1\n---\n\n# T <b>x</b>\n{{#include q}}\n| a |\n| - |\n![i](u)\n")
    assert (d.title, d.headings, d.tables, d.images) == ("T x", ["# T x"], 1, 1) and d.content.startswith("# T x")
    assert value(lambda x: M.text_document(x, F.lit("n")), "a\n*** START OF IT\nb\n*** END OF IT\nc").content == "# n\n\nb"
    assert value(M.front_matter, "no front") is None


def test_low_signal(value):
    assert value(T.low_signal, "License, copyright; trademark foundation") and not value(T.low_signal, "license copyright trademarks foundation")
    assert value(T.low_signal, "The Project Gutenberg book")


def test_reference_functions(value):
    c = value(R.candidates, "See `docs/a.md`, ./b/c.PY and AE-03, RFC-9110; Section 3.2 or sec. 4, `Some Heading`, `foo_bar`, `REQ-77` and CamelCase plain.")
    assert c.path == ["docs/a.md", "./b/c.PY"] and c.identifier == ["RFC-9110", "REQ-77"] and c.section == ["3.2", "4"] and c.heading == ["Some Heading"]
    assert c.symbol[:2] == ["foo_bar", "docs/a.md"] and "CamelCase" in c.symbol and "plain" not in c.symbol
    assert value(R.section_prefix, " 2.1 Intro") == "2.1" and value(R.section_prefix, "Intro") is None
    assert [value(R.symbol_like, x) for x in ("u.s", "xiv", "a.b", "foo.bar", "foo_bar", "Foo", "FooBar", "license")] == [False, False, False, True, True, False, True, False]
    assert value(R.normal_path, " ../.Github\\X.md") == "github/x.md"


def test_pdf_text(value):
    assert value(lambda x: P.drop_caps(P.ligatures(x)), "T\nHE ﬁne eﬀort") == "THE fine effort"
    prose = "This is a line of real prose that is long enough."
    assert value(P.without_toc, f"Head\n\nContents\n1 A .... 2\n3\n\n# Start\n{prose}\nx") == f"Head\n\n# Start\n{prose}\nx"
    assert value(P.without_toc, "Head\n\n## Table of Contents\n1 A .... 2") == "Head\n"
    assert value(P.without_toc, f"Contents\n{prose}\n{prose}") == f"\n\n{prose}\n{prose}"
    assert value(P.without_toc, "no contents here") == "no contents here"
    assert value(P.without_outer_fence, "```md\nbody\n```") == "body" and value(P.without_outer_fence, "```\na\n```\nb\n```") == "```\na\n```\nb\n```"
    assert value(lambda x: P.prefer_plain(x, F.lit("p")), "") and not value(lambda x: P.prefer_plain(x, F.lit("")), "m")
    assert value(lambda x: P.prefer_plain(x, F.lit("1 Alpha\n2 Beta\n3 Gamma")), "alpha beta")
    assert value(lambda x: P.prefer_plain(x, F.lit("p")), "x" * 1500)
    assert value(P.as_markdown, "A Study of Many Things\n1.2 Part\nAbstract\ntext\nA Study of Many Things") == "# A Study of Many Things\n\n### 1.2 Part\n## Abstract\ntext"
