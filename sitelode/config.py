"""Run parameters with their declared defaults."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class RunConfig:
    """The defaults are those of the declared configuration."""

    max_pages: int = 500
    crawl_delay: float = 1.0
    max_concurrent_crawls: int = 3
    respect_robots: bool = True
    min_search_volume: int = 10
    max_ads_competition: float = 0.8
    max_difficulty: float = 70.0
    min_cluster_size: int = 3
    clustering_method: str = "hdbscan"
    calendar_weeks: int = 36
    content_mix: dict = field(default_factory=lambda: {"blog": 20, "service": 10, "landing": 4, "product": 2})
    nli_threshold: float = 0.8
    require_site_evidence: bool = True
    language: str = "en-GB"
    readability_target: str = "university"
    export_format: str = "excel"
    include_drafts: bool = True
    include_briefs: bool = True

    def to_frame(self, spark: SparkSession, config_id: str = "default") -> DataFrame:
        """One-row table for the rule checks."""
        row = {k: v for k, v in asdict(self).items() if k != "content_mix"}
        schema = (
            "config_id string, max_pages int, crawl_delay double, max_concurrent_crawls int, "
            "respect_robots boolean, min_search_volume int, max_ads_competition double, max_difficulty double, "
            "min_cluster_size int, clustering_method string, calendar_weeks int, nli_threshold double, "
            "require_site_evidence boolean, language string, readability_target string, export_format string, "
            "include_drafts boolean, include_briefs boolean"
        )
        return spark.createDataFrame([{"config_id": config_id, **row}], schema)
