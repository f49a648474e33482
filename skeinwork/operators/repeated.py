"""Lines that recur on the pages of a document, such as running heads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, strip


def repeated_lines(pages: DataFrame, share: float = 0.5) -> DataFrame:
    """pages (doc, page, text) to (doc, line): lines of up to 79 characters that stand on two pages at least, and on the given share of them. A page's lines are told apart before they are stripped."""
    counted = pages.groupBy("doc").agg(F.count("*").alias("pages"))
    each = pages.select("doc", F.explode(F.array_distinct(lines(strip(F.col("text"))))).alias("line")).withColumn("line", strip(F.col("line")))
    seen = each.where("line <> '' AND length(line) < 80").groupBy("doc", "line").agg(F.count("*").alias("n"))
    return seen.join(counted, "doc").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share))).select("doc", "line")
