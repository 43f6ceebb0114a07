"""Jobs, status logs and streams."""

from pyspark.sql import functions as F

from ..operators import reports as A
from ..session import scratch_path
from ..streaming import intake, jobs as J
from . import inputs as I
from .registry import query

_LATEST = f"""WITH {I.JOB_LOG} SELECT job_id, status, progress, error, updated_at, done AS completed_at FROM j
JOIN (SELECT job_id, max(updated_at) FILTER (WHERE status = 'completed') AS done FROM j GROUP BY 1) USING (job_id)
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, seq DESC) = 1"""


@query(_LATEST)
def latest_job_states(spark, sf_dir):
    return J.latest_job_state(I.job_log(spark, sf_dir))


@query(_LATEST)
def streamed_job_states(spark, sf_dir):
    """The same states from a stream over the event file, run until its input is used up."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(I.stream_path(sf_dir, "events"))
    out = scratch_path(spark, "states")
    J.start_state_stream(I.to_job_log(events), out, f"{out}-log").awaitTermination()
    return J.read_states(spark, out)


@query(f"""WITH {I.JOB_LOG} SELECT job_id, seq, status, updated_at, lead(updated_at) OVER w AS next_at,
  round(epoch_us(lead(updated_at) OVER w) / 1e6 - epoch_us(updated_at) / 1e6, 3) AS seconds FROM j
  WINDOW w AS (PARTITION BY job_id ORDER BY updated_at, seq)""")
def stage_durations(spark, sf_dir):
    return J.stage_durations(I.job_log(spark, sf_dir)).withColumn("seconds", F.round("seconds", 3))


@query(f"""WITH {I.JOB_LOG} SELECT job_id, min(updated_at) AS created_at, max(updated_at) AS updated_at,
  max(updated_at) FILTER (WHERE status = 'completed') AS completed_at,
  round(epoch_us(max(updated_at)) / 1e6 - epoch_us(min(updated_at)) / 1e6, 3) AS seconds FROM j GROUP BY job_id""")
def job_durations(spark, sf_dir):
    return J.job_durations(I.job_log(spark, sf_dir)).withColumn("seconds", F.round("seconds", 3))


@query(f"WITH {I.TEXTS} SELECT site_id, crawl_seq, url, CASE WHEN text_content = '' THEN 0 ELSE len(string_split(text_content, ' ')) END AS word_count FROM t")
def streamed_pages(spark, sf_dir):
    """Incremental intake of the stored pages."""
    out = scratch_path(spark, "pages")
    parsed = intake.parse_stream(intake.stream_pages(spark, I.stream_path(sf_dir, "pages")))
    intake.write_stream(parsed, out, f"{out}-log").awaitTermination()
    return spark.read.parquet(out).select("site_id", "crawl_seq", "url", F.col("word_count").cast("long").alias("word_count"))


@query(f"WITH {I.TEXTS} SELECT site_id, crawl_seq, url, CASE WHEN text_content = '' THEN 0 ELSE len(string_split(text_content, ' ')) END AS word_count FROM t")
def pages_taken_once(spark, sf_dir):
    """The stored pages streamed in twice, the second time by a stream that knows nothing of the first: each is stored once."""
    out = scratch_path(spark, "pages")
    for run in ("first", "again"):
        arriving = intake.arriving_pages(spark, I.stream_path(sf_dir, "pages"))
        intake.take_pages(arriving, out, f"{out}-log-{run}").awaitTermination()
    return intake.read_pages_taken(spark, out).select("site_id", "crawl_seq", "url", F.col("word_count").cast("long").alias("word_count"))


def _children(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("job_id"), "o_orderstatus")
    return {"calendar_items": orders, "briefs_generated": orders.filter("o_orderstatus = 'F'"),
            "drafts_written": orders.filter("o_orderstatus = 'O'")}


@query(f"""WITH {I.JOBS}, o AS (SELECT o_custkey::VARCHAR AS job_id, o_orderstatus AS s FROM orders)
SELECT c.job_id, c.status, count(s) AS calendar_items, count(*) FILTER (WHERE s = 'F') AS briefs_generated,
count(*) FILTER (WHERE s = 'O') AS drafts_written FROM c LEFT JOIN o ON o.job_id = c.job_id GROUP BY 1, 2""")
def job_results(spark, sf_dir):
    return A.job_results(I.jobs(spark, sf_dir).select("job_id", "status"), **_children(spark, sf_dir))


@query(f"WITH {I.JOBS} SELECT job_id, url, status, created_at, progress FROM c")
def job_list(spark, sf_dir):
    return A.list_jobs(I.jobs(spark, sf_dir))


@query("SELECT count(*) AS total FROM customer")
def job_total(spark, sf_dir):
    return A.count_jobs(I.jobs(spark, sf_dir))


@query(f"""WITH {I.JOBS}, ids AS (SELECT DISTINCT user_id::VARCHAR AS job_id FROM events UNION SELECT 'none-' || event_id FROM events)
SELECT job_id, c.status, c.job_id IS NOT NULL AS found FROM ids LEFT JOIN c USING (job_id)""")
def job_lookup(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")
    ids = e.select(F.col("user_id").cast("string").alias("job_id")).distinct().unionByName(
        e.select(F.concat(F.lit("none-"), F.col("event_id").cast("string")).alias("job_id")))
    return A.lookup_jobs(ids, I.jobs(spark, sf_dir)).select("job_id", "status", "found")
