"""The chunk index as Parquet: vector and metadata in the same row cannot drift apart.

Every write goes to a folder of its own; a manifest, to which one row is appended last, says which folders are the
index. A write that breaks off anywhere leaves the index as it was.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesift.operators.contracts import check_index_facts, index_stats

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


# One row per commit: a folder below the path (NULL: the files in the path itself), whether it adds to the folders
# before it or replaces them, the saved encoder of its vectors, if it has one, and what is in it.
MANIFEST = "made long, folder string, adds boolean, encoder string, n_chunks long, n_vectors long, min_dim long, max_dim long"


def write_index(index: DataFrame, path: str, encoder: str | None = None) -> None:
    """Save an index as a new version, then switch to it by one appended row of the manifest.

    The version before stays on disk and stays the index until then, whatever breaks in between; running
    readers keep it. ``remove_old_versions`` frees it. The manifest holds the facts about what was saved.
    """
    _commit(index, path, f"version={uuid.uuid4().hex}", False, encoder)


def add_to_index(index: DataFrame, path: str, name: str) -> None:
    """Add rows to the index, whole or not at all. A ``name`` that was added before is left as it is.

    It starts an index where there is none. One writer adds at a time.
    """
    folder = f"added={name}"
    if all(c.folder != folder for c in _commits(index.sparkSession, path)):
        _commit(index, path, folder, True)


def record_facts(spark: SparkSession, path: str) -> None:
    """Take the table of files in ``path`` itself as the index, for example after a file sink wrote there."""
    if not _loose_files(spark, path):
        raise ValueError(f"{path} itself holds no files of a table")
    _append(spark, path, None, False, spark.read.schema(INDEX_SCHEMA).parquet(path))


def index_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is an index, or files of one without facts. A version that was never switched to is none."""
    return bool(_commits(spark, path)) or _loose_files(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Open a saved index. It must hold what was written, with one vector of one size per chunk.

    Only the row count is taken again, from file footers; no vector is read. A table without facts
    (a write that was cut off before it was switched to, or a sink whose facts were not recorded) is an error.
    """
    commits = _current(_commits(spark, path))
    if not commits:
        raise ValueError(f"{path} has no recorded facts: check it, then call record_facts")
    if commits[0].folder is None:
        index = spark.read.schema(INDEX_SCHEMA).parquet(path)
    else:
        index = spark.read.schema(INDEX_SCHEMA).parquet(*[f"{path}/{c.folder}" for c in commits])
        if _loose_files(spark, path):
            raise ValueError(f"{path} holds files besides those that were saved")
    held = [c for c in commits if c.n_chunks] or commits
    facts = {f: sum(c[f] for c in commits) for f in ("n_chunks", "n_vectors")}
    facts |= {"min_dim": min(c.min_dim for c in held), "max_dim": max(c.max_dim for c in held)}
    check_index_facts(facts, index.count())
    return index


def remove_old_versions(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders that the manifest has replaced, and name them. No reader may use them any more."""
    commits = _commits(spark, path)
    kept = {c.folder for c in _current(commits)}
    old = sorted({c.folder for c in commits if c.folder} - kept)
    jvm = spark.sparkContext._jvm
    for folder in old:
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return old


def saved_encoder(spark: SparkSession, path: str) -> str | None:
    """The name of the encoder that was saved with the index."""
    commits = _current(_commits(spark, path))
    return commits[0].encoder if commits else None


def _commit(index: DataFrame, path: str, folder: str, adds: bool, encoder: str | None = None) -> None:
    spark, place = index.sparkSession, f"{path}/{folder}"
    index.select(INDEX_SCHEMA.names).write.mode("overwrite").parquet(place)
    _append(spark, path, folder, adds, spark.read.schema(INDEX_SCHEMA).parquet(place), encoder)


def _append(
    spark: SparkSession, path: str, folder: str | None, adds: bool, saved: DataFrame, encoder: str | None = None
) -> None:
    made = max((c.made for c in _commits(spark, path)), default=0) + 1
    commit = [F.lit(made).alias("made"), F.lit(folder).alias("folder"), F.lit(adds).alias("adds"), F.lit(encoder).alias("encoder")]
    row = index_stats(saved).select(*commit, "*")
    row.coalesce(1).write.mode("append").json(f"{path}.facts")


def _commits(spark: SparkSession, path: str) -> list[Row]:
    """The manifest in order: one row per write, or per batch of a stream."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}.facts").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(rows, key=lambda c: (c.made, c.folder or ""))


def _current(commits: list[Row]) -> list[Row]:
    """The last row that replaces, and those after it."""
    start = max((i for i, c in enumerate(commits) if not c.adds), default=0)
    return commits[start:]


def _loose_files(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/*.parquet")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True
