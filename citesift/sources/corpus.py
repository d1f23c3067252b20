"""Document sources: a folder of text files, or a table that already holds texts."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.functions.text import strip

# Which files are documents.
TEXT_SUFFIXES = ("txt", "md")

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def read_text_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, source, text`` for every text file below ``root``.

    ``doc_id`` is the path below the root. Text is stripped, blank files are left out. A missing
    root and bytes that are not UTF-8 are errors. As everywhere in Spark, files whose name starts
    with ``_`` or ``.`` are not listed.
    """
    if ":" not in root.split("/")[0]:
        root = os.path.abspath(root)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        files = reader.load(root).select("path", "content")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no corpus at {root}") from e
        raise
    plain = F.regexp_replace("path", SCHEME, "")
    plain_root = root if ":" not in root.split("/")[0] else _without_scheme(root)
    suffix = F.lower(F.regexp_extract(plain, r"[^/.][^/]*\.([^/.]+)$", 1))
    source = F.when(F.startswith("path", F.lit("file:")), plain).otherwise(F.col("path"))
    return (
        files.where(suffix.isin(*TEXT_SUFFIXES))
        .select(
            F.substring(plain, F.lit(len(plain_root.rstrip("/")) + 2), F.length(plain)).alias("doc_id"),
            source.alias("source"),
            strip(F.validate_utf8(F.col("content").cast("string"))).alias("text"),
        )
        .where(F.col("text") != "")
    )


def documents_from_table(
    table: DataFrame, doc_id: str = "doc_id", text: str = "text", source: Column | str = "source"
) -> DataFrame:
    """The same shape from a table; rows without text are left out like blank files."""
    source = F.col(source) if isinstance(source, str) else source
    return table.select(
        F.col(doc_id).cast("string").alias("doc_id"),
        source.alias("source"),
        strip(F.col(text)).alias("text"),
    ).where(F.col("text") != "")


def _without_scheme(uri: str) -> str:
    rest = uri.split(":", 1)[1]
    return "/" + rest[2:].split("/", 1)[1] if rest.startswith("//") else rest
