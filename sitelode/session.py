"""Session defaults and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


# Setting: partitions that large text inputs are dealt to when they are read.
INPUT_PARTITIONS = "spark.sitelode.inputPartitions"


def build_session(app_name: str = "sitelode", master: str | None = None, shared: str | None = None, **conf: str) -> SparkSession:
    """Session with the engine's defaults; later ``conf`` entries win. ``shared`` is the folder, reachable by
    every executor, for tables between steps (``spark.checkpoint.dir``)."""
    builder = SparkSession.builder.appName(app_name)
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many partitions as ``spark.sitelode.inputPartitions`` says; as it is where that is not set.

    For deployments whose inputs are few large row groups, which Spark cannot split. It is a setting and never follows from sizes.
    """
    n = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(n), *keys) if n else df


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster an executor could
    not read another machine's disk, so an unset folder is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sitelode-checkpoint-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's path object and file system of ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in whatever store it names."""
    at, store = file_system(spark, path)
    return store.exists(at)


# Tables written by this process, for :func:`drop_tables`.
WRITTEN: list[str] = []


def drop_tables(spark: SparkSession) -> int:
    """Delete the tables that :func:`durable` wrote in this process, once nothing reads them any more; how many there were."""
    n = len(WRITTEN)
    while WRITTEN:
        path, store = file_system(spark, WRITTEN.pop())
        store.delete(path, True)
    return n


def drop_table(spark: SparkSession, table: str) -> None:
    """Delete one table that :func:`durable` wrote at ``table``, once nothing reads it any more."""
    path, store = file_system(spark, table)
    store.delete(path, True)
    if table in WRITTEN:
        WRITTEN.remove(table)


def durable(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; its path is added to ``paths``, for :func:`drop_table`.

    Cuts the lineage, survives lost executors, and gives later joins a measured size. Compressed by zstd: such tables are disk that no result needs.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable_buckets(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Like :func:`durable`, in ``buckets`` buckets by the hash of ``keys``: joins on the keys read it without a shuffle.

    Spark writes buckets by way of the catalog; the name is dropped at once, and the files stay with the returned relation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "buckets")
    name = "sitelode_" + uuid.uuid4().hex
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    WRITTEN.append(path)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table
