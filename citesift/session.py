"""Session helpers: a local session for tests and benchmarks, and the shared work folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "citesift", cpus: str = "8", memory: str = "16g") -> SparkSession:
    """A local[*] session. On a cluster the caller brings its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Folder shared by all executors for written intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local session that names
    none gets a temporary folder; on a cluster that is an error, because a folder on one machine
    would be lost with it.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="citesift-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/citesift/{context.applicationId}"


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    """Cut lineage through a Parquet table: a lost executor re-reads it, nothing is recomputed."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Give a table scan at least one partition per core.

    A file with one row group is one task however many cores there are. Large inputs have more
    splits than cores and pass unchanged, without a shuffle.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(slots) if scan.rdd.getNumPartitions() < slots else scan


def pack_for_training(rows: DataFrame, n_rows: int, row_bytes: int, split_bytes: int = 16 << 20) -> DataFrame:
    """As many partitions as the training data needs, and not more.

    Iterative fits start one task per partition and iteration, so small training sets belong in few
    partitions; large ones keep all they have.
    """
    return rows.coalesce(max(1, -(-n_rows * row_bytes // split_bytes)))
