"""What a single file or text gives, as plain values."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import ESTIMATE
from .operators import chunking
from .sources import files
from .tokens import counter, shown


@dataclass
class DocumentMetadata:
    source: str
    format: str
    title: str = ""
    pages: int = 0
    headings: list[str] = field(default_factory=list)
    tables: int = 0
    images: int = 0
    tokens_estimate: int = 0
    encoding: str = ""

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class ConvertResult:
    content: str
    metadata: DocumentMetadata


@dataclass
class ChunkResult:
    chunks: list[str]
    metadata: DocumentMetadata
    output_files: list[str] = field(default_factory=list)


def convert(spark: SparkSession, path: str, encoding: str = ESTIMATE, pdf_engine: str = "fast") -> ConvertResult:
    """One file, by the plan that converts folders of them."""
    stem, extension = os.path.splitext(os.path.basename(path))
    if extension.lower() not in files.FORMATS:
        raise ValueError(f"no converter for {extension}; there are {', '.join(files.supported_extensions())}")
    found = spark.read.format("binaryFile").load(path).select(F.lit(stem + extension).alias("original_source"), F.lit(extension.lower()).alias("extension"), F.lit(stem).alias("stem"), F.col("content").alias("data"))
    r = files.documents(found, counter(encoding), shown(encoding), pdf_engine).first()
    return ConvertResult(r.content, DocumentMetadata(path, r.format, r.title, r.pages or 0, list(r.headings), r.tables, r.images, r.tokens_estimate, r.encoding))


def chunk(result: ConvertResult, by: str = "heading", size: int = 500, encoding: str = ESTIMATE) -> ChunkResult:
    """The chunks of a converted file."""
    return ChunkResult(chunking.split(result.content, by, size, counter(encoding)), result.metadata)
