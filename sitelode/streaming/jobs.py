"""Job state from a status log, as a batch table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import RANGE_ROWS, next_in_group

# Progress reached at the end of each stage.
STAGE_PROGRESS = {"crawling": 20, "analyzing": 30, "researching": 40, "exporting": 90, "completed": 100}


def stage_progress(status) -> F.Column:
    """Progress for a status; NULL for statuses that report none."""
    table = F.create_map(*[F.lit(x) for pair in STAGE_PROGRESS.items() for x in pair])
    return F.try_element_at(table, F.col(status) if isinstance(status, str) else status)


def latest_job_state(log: DataFrame) -> DataFrame:
    """Newest status row per job: ``job_id, status, progress, error, updated_at, completed_at``.

    ``log`` has ``job_id, seq, status, progress, error, updated_at``; ``seq`` breaks ties. A plain aggregate, so
    the same code serves a stream in update mode with one state row per job.
    """
    order = F.struct("updated_at", "seq")
    done = F.max(F.when(F.col("status") == "completed", F.col("updated_at")))
    return log.groupBy("job_id").agg(
        F.max_by(F.struct("status", "progress", "error", "updated_at"), order).alias("_last"), done.alias("completed_at"),
    ).select("job_id", "_last.status", "_last.progress", "_last.error", "_last.updated_at", "completed_at")


def start_state_stream(log: DataFrame, path: str, checkpoint: str):
    """Run ``latest_job_state`` on a streaming log until the available input is used up.

    Each batch replaces the states of the jobs it touched: it is written under its own batch id, so a
    re-run of a batch after a failure overwrites its own output. ``read_states`` gives the current table.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        latest_job_state(log).writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _newest(rows: DataFrame) -> DataFrame:
    fields = [c for c in rows.columns if c not in ("job_id", "batch")]
    newest = rows.groupBy("job_id").agg(F.max_by(F.struct(*fields), "batch").alias("_s"))
    return newest.select("job_id", *[F.col(f"_s.{c}").alias(c) for c in fields])


def _folded(spark, path: str) -> tuple[str, int] | None:
    """Newest folded table beside ``path`` that is complete, and the last batch in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = f"{path}-folded"
    names = [s.getPath().getName() for s in files.listStatus(at(base))] if files.exists(at(base)) else []
    done = [int(n.split("=")[1]) for n in names if n.startswith("upto=") and files.exists(at(f"{base}/{n}/_SUCCESS"))]
    return (f"{path}-folded/upto={max(done)}", max(done)) if done else None


def read_states(spark, path: str) -> DataFrame:
    """Current state per job: the newest folded table, if there is one, and the batches written after it."""
    rows = spark.read.parquet(path)
    folded = _folded(spark, path)
    if folded is None:
        return _newest(rows)
    table, last = folded
    before = spark.read.parquet(table).withColumn("batch", F.lit(last).cast(rows.schema["batch"].dataType))
    return _newest(rows.filter(F.col("batch") > last).unionByName(before))


def fold_states(spark, path: str) -> int:
    """Fold all batches so far into one table beside ``path``; returns the last batch in it.

    From then on readers skip these batches. A fold that fails leaves no complete table and changes nothing; folding
    again starts from the last complete one. Folded batches are kept for the caller to expire.
    """
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    read_states(spark, path).write.mode("overwrite").parquet(f"{path}-folded/upto={last}")
    return last


def stage_durations(log: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Seconds from each status row to the next of the same job (NULL for the last).

    A log that one task cannot hold is ordered in ranges, so a job with very many rows does no harm.
    """
    timed = next_in_group(log, ["job_id"], ["updated_at", "seq"], "updated_at", "next_at", range_rows)
    return timed.withColumn(
        "seconds", F.timestamp_diff("MICROSECOND", F.col("updated_at"), F.col("next_at")) / 1e6,
    ).select("job_id", "seq", "status", "updated_at", "next_at", "seconds")


def job_durations(log: DataFrame) -> DataFrame:
    """First, last and completion time of each job and the seconds between first and last row."""
    return log.groupBy("job_id").agg(
        F.min("updated_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
        F.max(F.when(F.col("status") == "completed", F.col("updated_at"))).alias("completed_at"),
    ).withColumn("seconds", F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("updated_at")) / 1e6)
