"""Session settings and the shared work area used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g", app: str = "tonemill") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the cluster's own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a
    machine-local path would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tonemill-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy text work on a table that arrives in few partitions.

    A small table may sit in one unsplittable file; a large one has more
    partitions than cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def work_path(df: DataFrame, name: str) -> str:
    """Write ``df`` as a parquet table in the shared folder; it goes away with the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` in the shared folder and read it back.

    Used where one expensive frame feeds several jobs: the copy survives lost
    executors, stays columnar (later scans prune and push down) and gives the
    optimizer real sizes.
    """
    return df.sparkSession.read.schema(df.schema).parquet(work_path(df, name))


def bucketed_table(df: DataFrame, key: str, name: str) -> DataFrame:
    """Store ``df`` in buckets of ``key`` in the shared folder; joins and groupings by it then don't move it again."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tables/{table}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.table(table)
