"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 16g pyspark-shell")

from sitelode.catalog import QUERIES  # noqa: E402
from sitelode.session import INPUT_PARTITIONS, build_session, drop_tables  # noqa: E402

HEADLINE = (
    "site_report", "page_titles", "parsed_pages", "page_links", "page_headings", "visible_texts", "main_texts",
    "blocks_without_boilerplate", "word_counts", "url_joins", "title_cased_texts", "unescaped_texts",
    "service_phrases", "exclusions", "audiences", "value_props", "entity_matches", "trigger_locations",
    "site_analysis", "business_records", "facet_counts", "robots_allowed_urls", "site_sitemap_urls",
    "crawl_frontier", "candidate_terms", "keyword_clusters", "cluster_rollups", "competitor_gaps",
    "content_calendar", "verified_keywords", "draft_checks", "keyword_violations", "brief_violations",
    "crawl_report_json", "brief_files", "calendar_index", "latest_job_states", "stage_durations",
    "streamed_pages", "numbered_rows", "loose_keyword_clusters", "keyword_pipeline", "full_export",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ["BENCH_QUERIES"].split() if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, INPUT_PARTITIONS: cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["site_report"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    drop_tables(spark)
    spark.stop()


main()
