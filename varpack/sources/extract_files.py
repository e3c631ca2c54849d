"""Extract files as lines, for the readers of the extract catalogue.

Any number of text files of any size: Spark splits large files into blocks, and a
line's number is made from where its block starts in the file and how many lines
of the block come before it. A line has at least one byte, so numbers rise in file
order and never meet those of the next block. Bytes that are no UTF-8 are replaced,
a byte-order mark at the start of a file is dropped; line ends may be any of the
usual three.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written


def read_extracts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(extract_id, line_no, text) of the text files under ``paths``; extract_id
    is the file's path. Blank lines are kept, as they count for the header scan."""
    raw = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    block = F.col("_metadata.file_block_start")
    # Written once: a line's place in its block must not depend on a second reading.
    lines = written(raw.select(F.col("_metadata.file_path").alias("extract_id"), block.alias("block"), F.monotonically_increasing_id().alias("at"),
                               F.make_valid_utf8("value").alias("text")))
    first = lines.groupBy("extract_id", "block").agg(F.min("at").alias("first"))
    line_no = F.col("block") + F.col("at") - F.col("first") + 1
    marked = (F.col("block") == 0) & (F.col("at") == F.col("first")) & F.col("text").startswith("\ufeff")
    return (lines.join(first, ["extract_id", "block"])
            .select("extract_id", line_no.alias("line_no"), F.when(marked, F.expr("substring(text, 2)")).otherwise(F.col("text")).alias("text")))
