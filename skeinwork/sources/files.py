"""Folders of files as tables of documents."""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown as M
from ..functions import pdf as P
from ..functions import text as X
from ..functions.arrow import by_slices
from ..operators.chunking import counted, estimate
from . import docx, html, pdf

#: Extensions and formats.
FORMATS = {".txt": "txt", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".docx": "docx", ".pdf": "pdf"}
DOCUMENT = T.StructType([T.StructField("content", T.StringType()), T.StructField("title", T.StringType()), T.StructField("headings", T.ArrayType(T.StringType())), T.StructField("tables", T.IntegerType()), T.StructField("images", T.IntegerType()), T.StructField("pages", T.IntegerType())])
_ARROW = pa.struct([("content", pa.string()), ("title", pa.string()), ("headings", pa.list_(pa.string())), ("tables", pa.int32()), ("images", pa.int32()), ("pages", pa.int32())])
Converter = Callable[[bytes, str], dict]
CONVERTERS: dict[str, Converter] = {}


def register(extension: str, converter: Converter) -> None:
    """Adds a converter, a picklable function from a file's bytes and stem to a document, for an extension."""
    extension = "." + extension.lower().lstrip(".")
    FORMATS.setdefault(extension, extension[1:])
    CONVERTERS[extension] = converter


def converter(extension: str) -> Converter:
    extension = "." + extension.lower().lstrip(".")
    if extension not in CONVERTERS:
        raise ValueError(f"no converter for {extension}; there are {', '.join(sorted(CONVERTERS))}")
    return CONVERTERS[extension]


def supported_extensions() -> list[str]:
    return sorted(FORMATS)


def _html(data: bytes, stem: str) -> dict:
    return html.convert(data.decode("utf-8", "replace"), stem, estimate)


def _pdf(name: str) -> Converter:
    """A converter with the engine of that name, which is looked up here, on the driver. Extraction may give Markdown that is worse than the plain text; then that is used."""
    run = pdf.engine(name)

    def convert(data: bytes, stem: str) -> dict:
        found = pdf.convert(data, stem, run, name != "scientific")
        plain = found.pop("plain")
        if name != "scientific" and pdf.prefer_plain(found["content"], plain, estimate):
            content = P.plain_to_markdown(plain)
            found |= {"content": content, "tables": 0, "headings": [x for x in content.split("\n") if x.startswith("#")]}
        return found

    return convert


def default_pdf(data: bytes, stem: str) -> dict:
    return _pdf("fast")(data, stem)


for _x in (".html", ".htm"):
    register(_x, _html)
register(".docx", docx.convert)
register(".pdf", default_pdf)


def _hidden(folder: str) -> list[str]:
    """The files below a folder that Spark's readers leave out, since a part of their path begins with a dot or an underscore."""
    uri = folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)
    store, top = pafs.FileSystem.from_uri(uri)
    found = store.get_file_info(pafs.FileSelector(top, recursive=True))
    own = [x.path for x in found if x.is_file and any(part[0] in "._" for part in x.path[len(top) :].split("/") if part)]
    scheme = uri.split("://")[0] + "://" + ("" if uri.startswith("file:") else uri.split("://")[1].split("/")[0] + "/")
    return sorted(scheme + x for x in own if os.path.splitext(x)[1].lower() in FORMATS)


def _read(batches):
    for batch in batches:
        paths, data = batch.column(0).to_pylist(), []
        for path in paths:
            store, place = pafs.FileSystem.from_uri(path)
            with store.open_input_stream(place, compression=None) as f:
                data.append(f.read())
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(data, pa.binary())], names=["path", "content"])


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(original_source, extension, stem, data) of the files below a folder that have a known extension. Each file is one row and is converted by itself, in a Python worker that has one thread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    hidden = _hidden(folder)
    if hidden:
        files = files.unionByName(spark.createDataFrame([(x,) for x in hidden], "path string").mapInArrow(_read, "path string, content binary"))
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    plain = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "/")
    rel = F.expr(f"substring(rel, {len(root) + 2})")
    name = X.base_name(F.col("original_source"))
    return files.withColumn("rel", plain).withColumn("original_source", rel).select("original_source", F.lower(F.regexp_extract(name, r"([.][^.]+)$", 1)).alias("extension"), F.regexp_replace(name, r"(?<=.)[.][^.]*$", "").alias("stem"), F.col("content").alias("data")).where(F.col("extension").isin(supported_extensions()))


def path_order(path: Column) -> Column:
    """Sorts paths by their parts, not by their characters."""
    return F.split(path, "/")


def output_paths(files: DataFrame) -> DataFrame:
    """files (original_source) with out_rel, the path of the Markdown file; files that would share one get their extension into the name."""
    stem = F.regexp_replace("original_source", r"[.][^./]*$", "")
    extension = F.regexp_extract("original_source", r"[.]([^./]*)$", 1)
    shared = F.count("*").over(Window.partitionBy(stem))
    return files.withColumn("out_rel", F.concat(stem, F.when(shared > 1, F.concat(F.lit("_"), extension)).otherwise(F.lit("")), F.lit(".md")))


def documents(files: DataFrame, count=estimate, encoding: str = X.ESTIMATE, pdf_engine: str = "fast") -> DataFrame:
    """files (original_source, extension, stem, data) to documents. count gives a text's tokens, encoding is its name. Text and Markdown are converted by column functions, other formats by their converters; a file that fails fails the query."""
    placed = output_paths(files)
    raw = F.regexp_replace(F.decode("data", "UTF-8"), "^﻿", "")
    native = F.when(F.col("extension") == ".txt", M.text_document(raw, F.col("stem"))).otherwise(M.markdown_document(raw, F.col("stem")))
    text_like = F.col("extension").isin(".txt", ".md", ".markdown") & ~F.col("extension").isin(list(CONVERTERS))

    registered = dict(CONVERTERS)
    if registered[".pdf"] is default_pdf:
        registered[".pdf"] = _pdf(pdf_engine)

    @F.arrow_udf(DOCUMENT)
    def run(extension: pa.Array, stem: pa.Array, data: pa.Array) -> pa.Array:
        rows = lambda *some: [{"pages": None} | registered[e](d, s) for e, s, d in zip(*some)]
        return by_slices(rows, _ARROW, extension, stem, data)

    a = placed.where(text_like).select("original_source", "out_rel", "extension", native.alias("d")).select("original_source", "out_rel", "extension", "d.*", F.lit(None).cast("int").alias("pages"))
    b = placed.where(~text_like).select("original_source", "out_rel", "extension", run("extension", "stem", "data").alias("d")).select("original_source", "out_rel", "extension", "d.*")
    both = a.unionByName(b)
    formats = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return both.select("original_source", F.concat(F.lit("docs/full/"), "out_rel").alias("full_path"), formats[F.col("extension")].alias("format"), "title", "pages", "headings", "tables", "images", counted(F.col("content"), count).alias("tokens_estimate"), F.lit(encoding).alias("encoding"), "content")
