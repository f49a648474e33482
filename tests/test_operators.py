import json

import pytest

from skeinwork import tokens
from skeinwork.operators import chunking as C
from skeinwork.operators import graph, lexical, references, repeated, retrieval, semantic, validate
from skeinwork.plans import pack, queries
from skeinwork.sources import files


def test_heading_parts():
    assert C.by_headings("intro\n# A\ntext\n## B\n### C\nmore\n# End") == ["intro", "# A\ntext", "## B\n\n### C\nmore\n\n# End"]
    assert C.by_headings("Top\n===\nx\nSub\n---\ny") == ["Top\n===\nx", "Sub\n---\ny"]
    assert C.by_headings("") == [""] and C.by_headings("# only") == ["# only"]


def test_size_parts():
    words = lambda t: len(t.split())
    assert C.by_size("a a\n\nb b\n\nc", 4, words) == ["a a\n\nb b", "c"]
    assert C.by_size("a\n\n" + "b " * 9, 4, words) == ["a", "b " * 9]
    assert C.by_size("```\na a a\n\nb b b\n```\n\nc", 3, words) == ["```\na a a\n\nb b b\n```", "c"]
    assert C.by_size("# H\n\nlong words in this one", 2, words) == ["# H\n\nlong words in this one"]
    assert C.by_size("a a a\n\nChapter 2\n\nb", 4, words, sections=True) == ["a a a", "Chapter 2\n\nb"]
    assert [C.begins_section(x) for x in ("1.2 Intro here", "abstract", "PART ONE", "APPENDIX A: Z", "plain text", "# x", "", "1 lower")] == [True, True, True, True, False, True, False, False]
    assert C.split("x " * 10, "heading", 4, words) == [("x " * 10).strip()] and C.split("a\n\nb", "tokens", 1, words) == ["a", "b"]
    with pytest.raises(ValueError):
        C.parts(None, "lines")


def test_lexical_blocks(spark, monkeypatch):
    """The result doesn't depend on how many vectors a task compares."""
    rows = [(i, f"shared{i % 7} common{i % 3} own{i} alpha beta", str(i % 4)) for i in range(60)] + [(99, "", None)]
    nodes = spark.createDataFrame(rows, "key bigint, body string, grp string")
    get = lambda: sorted(map(tuple, lexical.relationships(nodes, 3, 0.05, True).select("src", "dst", "score").collect()))
    whole = get()
    monkeypatch.setattr(lexical, "BLOCK", 4)
    assert get() == whole and whole
    assert lexical.relationships(nodes.limit(0)).collect() == []


def test_semantic(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], "g"), ("b", [0.6, 0.8], "h"), ("c", [0.0, 1.0], "g"), ("z", [0.0, 0.0], "q"), ("s", [1.0], None)], "key string, v array<double>, grp string")
    got = [tuple(r) for r in semantic.neighbours(v, 3, 0.5).orderBy("src", "rank").collect()]
    assert got == [("a", "s", 1.0, 1), ("a", "b", 0.6, 2), ("b", "c", 0.8, 1), ("b", "a", 0.6, 2), ("b", "s", 0.6, 3), ("c", "b", 0.8, 1), ("s", "a", 1.0, 1), ("s", "b", 0.6, 2)]
    pairs = spark.createDataFrame([("g", "h"), ("h", "g")], "a string, b string")
    assert {(r.src, r.dst) for r in semantic.neighbours_in_groups(v, pairs, 3, 0.5).collect()} == {("a", "b"), ("c", "b"), ("b", "a"), ("b", "c")}
    row = spark.createDataFrame([([1.0, 0.0, 5.0], [0.6, 0.8])], "a array<double>, b array<float>").select(semantic.cosine(semantic.F.col("a"), semantic.F.col("b")).alias("c")).first()
    assert 0 < row.c < 1


def test_embedding_cache(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def backend(texts):
        seen.add(len(texts))
        return semantic.hashed(texts)

    nodes = spark.createDataFrame([("a", "red cars", "g"), ("b", "blue boats", "g"), ("c", "red cars", "h")], "key string, text string, grp string")
    first = {r.key: r.v for r in semantic.embed_cached(nodes, f"{tmp_path}/c", "m", backend).collect()}
    assert seen.value == 2 and first["a"] == first["c"]
    assert {r.key: r.v for r in semantic.embed_cached(nodes, f"{tmp_path}/c", "m", backend).collect()} == first and seen.value == 2


def test_references(spark):
    none = []
    t = spark.createDataFrame([("d1", "d1", ["a/x.md", "x.md"], ["RFC-100"], ["3.2"], ["Intro Part"], ["foo_bar"]), ("d2", "d2", ["y.md"], ["RFC-100"], ["3"], ["Intro Part"], none), ("d3", "d3", none, none, none, ["Unique Head"], none)], "key string, grp string, path_aliases array<string>, identifiers array<string>, section_numbers array<string>, headings array<string>, symbols array<string>")
    x = spark.createDataFrame([("d3", "d3", "see ./A/x.md, RFC-100, section 3.2 and section 3, `Intro Part`, `Unique Head`, foo_bar()"), ("d1", "d1", "RFC-100 `Unique head`")], "key string, grp string, text string")
    got = {(r.src, r.dst, r.kind, r.value, r.rank) for r in references.matches(x, t).collect()}
    assert got == {("d3", "d1", "path", "./A/x.md", 1), ("d3", "d1", "identifier", "RFC-100", 2), ("d3", "d1", "section", "3.2", 3), ("d3", "d1", "symbol", "foo_bar", 4), ("d3", "d2", "identifier", "RFC-100", 1), ("d1", "d2", "identifier", "RFC-100", 1), ("d1", "d3", "heading", "Unique head", 1)}


def test_fusion_and_filter(spark):
    refs = spark.createDataFrame([("a", "b", "path", "b.md", 1.0, 1), ("a", "b", "symbol", "s_s", 0.78, 2)], "src string, dst string, kind string, value string, score double, rank int")
    lex = spark.createDataFrame([("a", "b", 0.5, ["t"]), ("a", "c", 0.12, ["u"]), ("a", "d", 0.2, ["w"]), ("a", "e", 0.01, ["w"])], "src string, dst string, score double, shared_terms array<string>")
    sem = spark.createDataFrame([("a", "c", 0.62), ("b", "c", 0.61), ("b", "d", 0.85)], "src string, dst string, score double")
    fused = graph.fuse(refs, lex, sem, "document")
    got = {(r.src, r.dst): r for r in fused.collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")}
    assert (got["a", "b"].relationship_type, got["a", "b"].score, [tuple(x) for x in got["a", "b"].references]) == ("hybrid", 1.0, [("path", "b.md"), ("symbol", "s_s")])
    assert (got["a", "c"].relationship_type, got["a", "c"].score) == ("hybrid", 0.638) and got["a", "d"].relationship_type == "lexical_similarity"
    words = spark.createDataFrame([("a", ["one", "license"]), ("b", ["two", "six"]), ("c", ["six", "one", "two", "license"]), ("d", ["z"])], "full_path string, keywords array<string>")
    kept = {(r.src, r.dst): r.shared_terms for r in graph.filter_documents(fused, words, 4).collect()}
    assert kept == {("a", "b"): ["t"], ("a", "d"): ["w"], ("b", "c"): ["two", "six"], ("b", "d"): []}


def test_bridges(spark):
    chunks = spark.createDataFrame([("p1", "d1", 1, "h1"), ("p2", "d2", 1, "h2"), ("p3", "d3", 1, "h3")], "path string, full_path string, chunk_index int, heading string")
    lex = spark.createDataFrame([("p2", "p1", 0.4, ["x"]), ("p1", "p2", 0.4, ["x"]), ("p3", "p1", 0.9, ["x"])], "src string, dst string, score double, shared_terms array<string>")
    got = graph.bridges(graph.fuse(None, lex, None, "chunk"), chunks).collect()
    assert [(r.left_path, r.right_path, r.score) for r in got] == [("p3", "p1", 0.9), ("p1", "p2", 0.4)]


def test_repeated_lines(spark):
    pages = spark.createDataFrame([("d", k, f" Head \nbody {k}\n" + "x" * 90) for k in range(4)] + [("e", 0, "one")], "doc string, page int, text string")
    assert [tuple(r) for r in repeated.repeated_lines(pages).collect()] == [("d", "Head")]


def test_ranks_count_what_has_no_score(spark):
    found = spark.createDataFrame([(1, "m", 2.0), (1, "c", 1.0)], "query_id bigint, key string, score double")
    names = spark.createDataFrame([(x,) for x in "abcmz"], "key string")
    want = spark.createDataFrame([(1, "z")], "query_id bigint, key string")
    rank = lambda key: retrieval.rank_of(found, want.withColumn("key", retrieval.F.lit(key)), names).first().rank
    assert [rank(k) for k in "mcabzq"] == [1, 2, 3, 4, 5, None]


def test_pack(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    (src / "alpha.md").write_text("# Alpha Transformer\n\nAttention layers drive the encoder. See `beta.md` and RFC-101.\n\n## Attention\n\nAttention weights.")
    (src / "beta.md").write_text("# Beta Protocol\n\nCaching headers and validators. RFC-101 says so.\n\n## Attention\n\nAttention weights and caching.")
    (src / "gamma.html").write_text("<title>Gamma</title><body><h1>Gamma rules</h1><p>" + "Procurement clauses apply here. " * 12 + "</p></body>")
    assert pack.pack_folder(spark, str(src), str(out), ["all"]) == str(out)
    m = json.loads((out / "manifest.json").read_text())
    assert [d["original_source"] for d in m["documents"]] == ["alpha.md", "beta.md", "gamma.html"] and m["version"] == "3.0"
    assert all((out / f).exists() for f in m["output_files"]) and m["output_files"] == sorted(m["output_files"]) and "AGENTS.md" in m["output_files"]
    a = m["documents"][0]
    edge = a["related_documents"][0]
    assert edge["target_path"] == "docs/full/beta.md" and edge["signal_scores"]["reference_match"] == 1.0 and edge["evidence"]["references"][0] == {"type": "path", "value": "beta.md"}
    assert a["chunks"][0]["previous"] is None and a["chunks"][0]["next"] == a["chunks"][1]["path"] and m["total_chunks"] == sum(len(d["chunks"]) for d in m["documents"])
    meta, body = pack.parse_front_matter((out / a["chunks"][0]["path"]).read_text())
    assert meta["chunk_index"] == 1 and meta["source"] == a["full_path"] and body.startswith("# Alpha")
    assert "Cross-Document Bridges" in (out / "PROJECT_CONTEXT.md").read_text()
    assert not list(out.rglob("*.tmp")) and pack.load(spark, str(out)).first().total_chunks == m["total_chunks"]
    with pytest.raises(ValueError):
        pack.pack_folder(spark, str(src), str(out), ["nobody"])
    assert pack.free_folder(spark, str(out)) == f"{out}-1"
    # the same folder packed again gives the same bytes
    again = tmp_path / "again"
    pack.pack_folder(spark, str(src), str(again), ["all"])
    every = lambda root: {str(f.relative_to(root)): f.read_bytes() for f in root.rglob("*") if f.is_file() and not f.name.endswith(".crc")}
    assert every(out) == every(again)


def test_pack_in_parts_with_cache_and_vocabulary(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    (src / ".github").mkdir(parents=True)
    (src / "a.md").write_text("# A\n\nOne two three.")
    (src / ".github" / "b.md").write_text("# B\n\nFour five.")
    (src / "_c.txt").write_text("six")
    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    pack.pack_folder(spark, str(src), str(out), encoding=path, cache=f"{tmp_path}/cache")
    m = json.loads((out / "manifest.json").read_text())
    assert [d["original_source"] for d in m["documents"]] == [".github/b.md", "_c.txt", "a.md"]
    assert {d["encoding"] for d in m["documents"]} == {"byte_bpe_multi_50k"}
    encoder = tokens.counter(path)
    assert all(d["tokens_estimate"] == encoder(pack.parse_front_matter((out / d["full_path"]).read_text())[1]) for d in m["documents"])
    kept = spark.read.parquet(f"{tmp_path}/cache/hashed_stems")
    before = kept.count()
    assert before > 0 and before == kept.select("digest").distinct().count()
    built = pack.build(files.documents(files.discover(spark, str(src))), cache=f"{tmp_path}/cache")
    assert spark.read.parquet(f"{tmp_path}/cache/hashed_stems").count() == before
    pack.write(built, str(tmp_path / "parts"), manifest_lines=True)
    small = json.loads((tmp_path / "parts" / "manifest.json").read_text())
    assert small["documents"] == [] and small["total_chunks"] == m["total_chunks"]
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/parts/manifest-documents").collect()]
    assert [d["full_path"] for d in lines] == [d["full_path"] for d in m["documents"]]
    assert {r.value for r in spark.read.text(f"{tmp_path}/parts/manifest-files").collect()} == set(m["output_files"])


def test_artifacts_line_by_line(spark):
    """The map and the instructions of a pack made by hand."""
    docs = spark.createDataFrame([("docs/full/b.md", "b.md", "B", 1, 7, ["H1", "H2"], ["k"], None, "markdown"), ("docs/full/a/z.md", "a/z.txt", "Z", 0, 3, [], [], 2, "txt")], "full_path string, original_source string, title string, chunk_count int, tokens_estimate int, heading_samples array<string>, keywords array<string>, pages int, format string")
    chunks = spark.createDataFrame([("docs/chunks/b_001.md", "docs/full/b.md", 1, "One"), ("docs/chunks/c_001.md", "docs/full/c.md", 1, "Two")], "path string, full_path string, chunk_index int, heading string")
    lex = spark.createDataFrame([("docs/chunks/b_001.md", "docs/chunks/c_001.md", 0.5, ["term"])], "src string, dst string, score double, shared_terms array<string>")
    sem = spark.createDataFrame([("docs/full/b.md", "docs/full/a/z.md", 0.9)], "src string, dst string, score double")
    p = pack.Pack(docs, chunks, graph.fuse(None, None, sem, "document"), graph.fuse(None, lex, None, "chunk"))
    text = pack.project_context(p).first().text
    assert text.split("## Documents\n\n")[0].startswith("# Project Documentation Map\n\nTotal documents: 2\nTotal chunks: 1\nTotal estimated tokens: 10\n")
    assert text.split("## Documents\n\n")[1] == (
        "### Z\n- Original source: `a/z.txt`\n- Full document: `docs/full/a/z.md`\n- Pages: 2\n- Format: txt\n- Tokens: 3\n\n"
        "### B\n- Original source: `b.md`\n- Full document: `docs/full/b.md`\n- Chunks: 1\n- Start with: `docs/chunks/b_001.md`\n- Format: markdown\n- Tokens: 7\n- Key headings: H1, H2\n- Keywords: k\n- Related: Z [semantic_similarity]\n"
        "\n## Cross-Document Bridges\n\n- `docs/chunks/b_001.md` <-> `docs/chunks/c_001.md` [lexical_similarity] (score 0.5) via term\n"
    )
    assert "## Available Documents\n\n- **Z** (0 chunks, ~3 tokens)\n- **B** (1 chunks, ~7 tokens)\n\nGive paths" in pack.instructions(p, "codex").first().text


def test_filter_drops_keeps_and_fills(spark, small):
    """The query's corpus has edges that the filter drops, keeps by score, keeps by anchors, and explains by anchors."""
    fused = {(r.src, r.dst): r for r in queries.fused_without_most_references(spark, small).collect()}
    kept = {(r.src, r.dst): r for r in queries.QUERIES["filtered_edges"](spark, small).collect()}
    judged = {k for k, r in fused.items() if r.sem_score and not r.ref_score}
    assert set(kept) < set(fused) and all(k in kept for k in set(fused) - judged)
    by_anchors = [k for k in judged & set(kept) if fused[k].sem_score < 0.8]
    assert judged - set(kept) and by_anchors and all(fused[k].sem_score >= 0.6 for k in by_anchors)
    assert any(fused[k].sem_score >= 0.8 for k in judged & set(kept))
    filled = [k for k in kept if not fused[k].shared_terms and kept[k].shared_terms]
    assert filled and all(k in judged for k in filled)


def test_corpus_errors(spark, tmp_path):
    got = lambda folder, expected=None: [tuple(r) for r in validate.corpus_errors(spark, str(folder), expected).collect()]
    (tmp_path / "empty").mkdir()
    (tmp_path / "file.md").write_text("x")
    assert got(tmp_path / "none") == [("missing_source_dir", f"{tmp_path}/none")]
    assert got(tmp_path / "file.md") == [("not_a_directory", f"{tmp_path}/file.md")]
    assert got(tmp_path / "empty") == [("no_supported_files", f"{tmp_path}/empty")]
    (tmp_path / "empty" / "x.bin").write_text("x")
    assert got(tmp_path / "empty") == [("no_supported_files", f"{tmp_path}/empty")]
    (tmp_path / "src" / "sub").mkdir(parents=True)
    (tmp_path / "src" / "sub" / "here.md").write_text("# Here")
    expected = spark.createDataFrame([("here.md",), ("gone.html",), ("gone.html",)], "original_source string")
    assert got(tmp_path / "src") == [] and got(tmp_path / "src", expected) == [("missing_expected_document", "gone.html")]


def test_search_reads_written_files(spark, tmp_path):
    """A word that stands late in a document is found in its file, and isn't in the headings and previews."""
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    (src / "guide.txt").write_text("\n\n".join(f"Paragraph {k}: background." for k in range(90)) + "\n\nMore.\nThe zymurgy validators apply.")
    (src / "rules.md").write_text("# Rules\n\nGeneral rules for release management.")
    docs = files.documents(files.discover(spark, str(src)))
    p = pack.build(docs)
    pack.write(p, str(out))
    q = spark.createDataFrame([(1, "zymurgy"), (2, "words_and_marks")], "query_id int, query string")
    d, c = retrieval.searchable(p.documents, p.chunks, retrieval.written_files(spark, str(out)))
    assert [(r.query_id, r.key) for r in retrieval.best_documents(d, c, q, 1).orderBy("query_id").collect()] == [(1, "docs/full/guide.md"), (2, "docs/full/guide.md")]
    d, c = retrieval.searchable(p.documents, p.chunks)
    assert [r.query_id for r in retrieval.best_documents(d, c, q, 1).collect()] == []


def test_best_equals_ranked_scores(spark, small):
    """Scoring in blocks gives what the table of all scores gives, whatever the blocks."""
    d, c = queries._searchable(spark, small)
    d = d.where("doc_id < 30")
    c = c.join(d.select("full_path"), "full_path", "left_semi")
    q = queries._queries(spark, small).where("query_id < 7").unionByName(spark.createDataFrame([(91, None), (92, ""), (93, "note"), (94, "note 3")], "query_id bigint, query string"))
    whole = retrieval.chunk_scores(c, q)
    want = sorted(map(tuple, retrieval.ranked(whole, 4).select("query_id", "key", "score").collect()))
    docs = sorted(map(tuple, retrieval.ranked(retrieval.document_scores(d, q, whole, c), 4).select("query_id", "key", "score").collect()))
    old = retrieval.QUERY_BLOCK, retrieval.CELLS
    for retrieval.QUERY_BLOCK, retrieval.CELLS in (old, (4, 300)):
        assert sorted(map(tuple, retrieval.best_chunks(c, q, 4).select("query_id", "key", "score").collect())) == want
        assert sorted(map(tuple, retrieval.best_documents(d, c, q, 4).select("query_id", "key", "score").collect())) == docs
    retrieval.QUERY_BLOCK, retrieval.CELLS = old
    assert retrieval.best_chunks(c, q.limit(0), 4).collect() == [] and retrieval.best_documents(d.limit(0), c.limit(0), q, 4).collect() == []


def test_integrity_and_metrics(spark):
    d = spark.createDataFrame([("d1", 10, ["h"]), ("d2", 20, [])], "full_path string, tokens_estimate int, headings array<string>")
    c = spark.createDataFrame([("d1", "p1", 1, None, "p2", 4), ("d1", "p2", 2, "wrong", None, 9), ("d2", "p3", 1, None, None, 5)], "full_path string, path string, chunk_index int, previous string, next string, tokens_estimate int")
    e = spark.createDataFrame([("d1", "d2"), ("p1", "gone")], "src string, dst string")
    f = spark.createDataFrame([("d1",), ("p1",), ("p2",), ("p3",)], "path string")
    got = {tuple(r) for r in validate.integrity(d, c, e, f, spark.createDataFrame([("m",)], "path string")).collect()}
    assert got == {("missing_document", "d2", None), ("bad_previous", "p2", None), ("bad_target", "p1", "gone"), ("missing_output", "m", None)}
    m = validate.metrics(d, c, e.where("src = 'd1'"), e.where("src = 'p1'")).first()
    assert (m.documents, m.chunks, m.total_tokens, m.avg_chunk_tokens, m.median_chunk_tokens, m.p95_chunk_tokens, m.max_chunk_tokens, m.docs_without_headings, m.docs_without_related, m.chunks_without_related) == (2, 3, 30, 6.0, 5.0, 5, 9, 1, 1, 2)
    empty = validate.metrics(d.limit(0), c.limit(0), e.limit(0), e.limit(0)).first()
    assert empty.chunks == 0 and empty.p95_chunk_tokens == 0


def test_best_references_are_the_first_of_all(spark):
    """A graph of the best references is the graph of all, and a name that all texts have doesn't relate all of them on the way."""
    none = []
    name = lambda k: f"d{k:02}"
    t = spark.createDataFrame([(name(k), name(k // 4), [f"{name(k)}.md"], ["REQ-1", f"REQ-{k % 3 + 2}"], none, [f"Head {k}"], none) for k in range(40)], "key string, grp string, path_aliases array<string>, identifiers array<string>, section_numbers array<string>, headings array<string>, symbols array<string>")
    x = spark.createDataFrame([(name(k), name(k // 4), f"REQ-1 and REQ-{k % 3 + 2}, `Head {(k * 7) % 40}`, {name((k * 11) % 40)}.md") for k in range(40)] + [("e", None, "REQ-1 and d05.md")], "key string, grp string, text string")
    lex = spark.createDataFrame([(name(k), name((k + 17) % 40), 0.5, ["t"]) for k in range(40)], "src string, dst string, score double, shared_terms array<string>")
    rows = lambda df: sorted(map(repr, df.collect()))
    whole, best = references.matches(x, t), references.best(x, t, [lex])
    assert rows(graph.fuse(whole, None, None, "chunk")) == rows(graph.fuse(references.best(x, t), None, None, "chunk"))
    assert rows(graph.fuse(whole, lex, None, "chunk")) == rows(graph.fuse(best, lex, None, "chunk"))
    assert whole.count() > 1500 and best.count() < 500


def test_symbols_and_boilerplate_by_cheap_tests(spark):
    """The cheap tests before the costly ones let through what these would."""
    from skeinwork.functions import references as R
    from skeinwork.functions import text as T

    words = ["foo_bar", "a.b", "FooBar", "foo", "Foo", "XIV", "u.s", "e.g", "x_", "foo_bar()", "FooB", "İ.b", "king", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.w for r in df.where(R.symbol_like(R.F.col("w"))).collect()] == ["foo_bar", "FooBar", "x_", "foo_bar()", "İ.b"]
    texts = spark.createDataFrame([("License, trademark; donate ARCHIVE",), ("licensed trademarks donate archive",), ("Project Gutenberg",), (None,)], "t string")
    assert [r.f for r in texts.select(T.low_signal(R.F.col("t")).alias("f")).collect()] == [True, False, True, None]


def test_pairs_by_files(spark, monkeypatch):
    """Whatever the files, blocks and dense terms, results are those of all pairs; candidates are counted as they would be listed."""
    rows = [(i, f"shared{'x' * (i % 7)} common{'y' * (i % 3)} own{'z' * i} alpha beta " + "gamma " * (i % 5), str(i % 4)) for i in range(50)]
    nodes = spark.createDataFrame(rows, "key bigint, body string, grp string")
    v = spark.createDataFrame([(i, [float((i * k) % 11) for k in range(1, 6)], i % 3) for i in range(60)] + [(70, [0.0] * 5, 1), (71, [1.0], None)], "key bigint, v array<double>, grp int")
    pairs = spark.createDataFrame([(0, 1), (1, 0), (2, 2)], "a int, b int")
    top = lexical.salient(lexical.weights(nodes))
    F = lexical.F
    listed = sorted(map(tuple, lexical.candidates(top).groupBy("src").agg(F.count("*"), F.sum("dst")).collect()))
    every = lambda: [sorted(map(repr, df.collect())) for df in (lexical.relationships(nodes, 3, 0.05), semantic.neighbours(v, 3, 0.1, True), semantic.neighbours_in_groups(v, pairs, 3, 0.1))]
    whole = every()
    assert all(whole) and sorted(map(tuple, lexical.candidate_counts(top).collect())) == listed
    monkeypatch.setattr(lexical, "BLOCK", 7)
    monkeypatch.setattr(lexical, "DENSE", 3)
    monkeypatch.setattr(lexical, "STEP", 5)
    monkeypatch.setattr(semantic, "BLOCK", 9)
    monkeypatch.setattr(semantic, "GROUP_BLOCK", 8)
    assert every() == whole and sorted(map(tuple, lexical.candidate_counts(top).collect())) == listed


def test_evaluation_without_a_table_of_scores(spark, small, monkeypatch):
    """Ranks are those that the table of all scores gives, whatever the blocks; nothing makes that table."""
    d, c = queries._searchable(spark, small)
    d = d.where("doc_id < 30")
    c = c.join(d.select("full_path"), "full_path", "left_semi")
    F = retrieval.F
    q = queries._queries(spark, small).where("query_id < 6")
    cases = q.select("query_id", "query", F.expr("concat('note_', query_id, case when query_id % 4 = 3 then '.txt' else '.md' end)").alias("expected_document"), F.lit(None).cast("string").alias("expected_heading"), F.expr("case when query_id % 2 = 0 then concat('docs/chunks/note_', query_id, '_001.md') end").alias("expected_chunk"), F.lit(3).alias("top_k"))
    cs = retrieval.chunk_scores(c, q)
    ds = retrieval.document_scores(d, q, cs, c).join(d.select(F.col("full_path").alias("key"), "original_source"), "key").select("query_id", F.col("original_source").alias("key"), "score")
    rank = lambda found, want, names: {r.query_id: r.rank for r in retrieval.rank_of(found, cases.select("query_id", F.col(want).alias("key")), names).collect()}
    docs = rank(ds, "expected_document", d.select(F.col("original_source").alias("key")))
    parts = rank(cs, "expected_chunk", c.select(F.col("path").alias("key")))
    monkeypatch.setattr(retrieval, "chunk_scores", None)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    got = {r.query_id: (r.document_rank, r.chunk_rank) for r in retrieval.evaluate(d, c, cases).collect()}
    assert got == {k: (docs[k], parts[k]) for k in docs} and any(x for x, _ in got.values()) and any(y for _, y in got.values())


def test_columns_by_slices(monkeypatch):
    """A function sees a few rows of a batch at a time."""
    import pyarrow as pa

    from skeinwork.functions import arrow

    monkeypatch.setattr(arrow, "SLICE", 3)
    seen = []
    got = arrow.by_slices(lambda a, b: seen.append(len(a)) or [None if x is None else x * y for x, y in zip(a, b)], pa.int64(), pa.array([1, None, 3, 4]), pa.array([5, 6, 7, 8]))
    assert got.to_pylist() == [5, None, 21, 32] and seen == [3, 1]
    assert arrow.by_slices(list, pa.string(), pa.array([], pa.string())).to_pylist() == []
