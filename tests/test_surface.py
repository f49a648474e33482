import json

import pytest

import skeinwork
from skeinwork import tokens
from skeinwork.__main__ import main, parser
from skeinwork.operators import retrieval
from skeinwork.plans import pack
from skeinwork.sources import files, pdf
from skeinwork.streaming import ingest


def test_exports():
    assert {".md", ".txt", ".html", ".docx", ".pdf"} <= set(skeinwork.supported_extensions()) and callable(skeinwork.converter("HTML"))


def test_counters():
    assert tokens.counter()("a b!") == 3 and tokens.counter("o200k_base").name == "o200k_base"
    with pytest.raises(ValueError):
        tokens.counter("other")


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\ntext")
    assert main([str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-a", "codex", "--chunk-by", "tokens"]) == 0
    assert (tmp_path / "out" / "AGENTS.md").exists() and json.loads((tmp_path / "out" / "manifest.json").read_text())["chunk_strategy"] == "tokens"
    assert main([str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-a", "nobody"]) == 1
    assert parser().parse_args(["x"]).chunk_size == 500


def test_ingest(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    go = lambda: ingest.ingest(spark, str(src), f"{tmp_path}/table", f"{tmp_path}/cp").awaitTermination()
    (src / "a.md").write_text("# A\n\none")
    go()
    (src / "b.txt").write_text("two")
    (src / "c.bin").write_text("no")
    go()
    got = {r.original_source: r.title for r in spark.read.parquet(f"{tmp_path}/table").collect()}
    assert got == {"a.md": "A", "b.txt": "b"}


def test_own_converter_and_pdf_fallback(spark, tmp_path):
    pdf.register("fast", lambda data: ("x" * 2000, ["1 Alpha\nBody text of the file"]))
    files.register("xyz", lambda data, stem: {"content": data.decode().upper(), "title": stem, "headings": [], "tables": 0, "images": 0})
    try:
        (tmp_path / "p.pdf").write_bytes(b"%PDF")
        (tmp_path / "q.xyz").write_text("up")
        got = {r.original_source: r for r in files.documents(files.discover(spark, str(tmp_path))).collect()}
        assert got["p.pdf"].content.startswith("# Body text of the file") and got["p.pdf"].pages == 1 and got["q.xyz"].content == "UP"
    finally:
        pdf.register("fast", pdf._mupdf)
        del files.FORMATS[".xyz"], files.CONVERTERS[".xyz"]


def test_cases(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "q", "query": "caching headers", "expected_document": "b.md", "expected_chunk_heading_contains": "Cach"}]))
    d = spark.createDataFrame([("docs/full/a.md", "a.md", "A", ["x"], ["A"], "attention layers"), ("docs/full/b.md", "b.md", "B", ["caching"], ["Caching"], "# Caching\n\ncaching headers here")], "full_path string, original_source string, title string, keywords array<string>, heading_samples array<string>, content string")
    from skeinwork.operators.chunking import chunks

    got = retrieval.evaluate(d, chunks(d), pack.retrieval_cases(spark, str(tmp_path / "cases.json"))).collect()
    assert [tuple(r) for r in got] == [("q", 1, 1, True)]
