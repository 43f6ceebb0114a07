"""Declared record constraints as table checks: one scan per table reports every violation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.text import word_count
from ..functions.urls import is_http_url


@dataclass(frozen=True)
class Rule:
    """``ok`` NULL counts as passed, so optional fields may be NULL; required fields say so."""

    field: str
    name: str
    ok: Column
    value: Column


def _show(field: str) -> Column:
    return F.col(field).cast("string")


def required(field: str) -> Rule:
    return Rule(field, "required", F.col(field).isNotNull(), _show(field))


def at_least(field: str, low: float) -> Rule:
    return Rule(field, f"min_{low:g}", F.col(field) >= F.lit(low), _show(field))


def within(field: str, low: float, high: float) -> Rule:
    return Rule(field, f"range_{low:g}_{high:g}", F.col(field).between(low, high), _show(field))


def one_of(field: str, allowed: Sequence[str]) -> Rule:
    return Rule(field, "allowed", F.col(field).isin(*allowed), _show(field))


def text_length(field: str, low: int, high: int) -> Rule:
    size = F.length(field)
    return Rule(field, f"length_{low}_{high}", size.between(low, high), size.cast("string"))


def list_size(field: str, low: int, high: int | None = None) -> Rule:
    size = F.when(F.col(field).isNotNull(), F.size(field))
    ok = size >= low if high is None else size.between(low, high)
    return Rule(field, f"size_{low}_{'up' if high is None else high}", ok, size.cast("string"))


def http_url(field: str) -> Rule:
    return Rule(field, "url", F.when(F.col(field).isNotNull(), is_http_url(field)), _show(field))


def every_item(field: str, name: str, test) -> Rule:
    """All items of a list pass, NULL ones do not; the shown value is the number that fail."""
    failing = F.size(F.filter(field, lambda item: ~F.coalesce(test(item), F.lit(False))))
    return Rule(field, name, F.when(F.col(field).isNotNull(), failing == 0), failing.cast("string"))


def _min_words(text: Column, n: int) -> Column:
    return word_count(text) >= n


def rules_for(table: str) -> list[Rule]:
    """The ranges, sizes and sets of the declared data model."""
    if table == "keyword":
        return [required("term"), required("volume"), required("intent"), at_least("volume", 0),
                within("ads_competition", 0, 1), at_least("cpc", 0), at_least("score", 0),
                within("difficulty_proxy", 0, 100), one_of("intent", S.INTENTS)]
    if table == "cluster":
        return [*map(required, ("id", "label", "pillar", "primary_terms", "avg_volume", "total_volume", "dominant_intent",
                                "content_type_suggestion")), list_size("primary_terms", 1),
                at_least("avg_volume", 0), at_least("total_volume", 0), one_of("dominant_intent", S.INTENTS),
                one_of("content_type_suggestion", S.CONTENT_TYPES)]
    if table == "gap":
        return [*map(required, ("keyword", "volume", "competitors_ranking", "gap_score", "opportunity_type")),
                at_least("volume", 0), at_least("gap_score", 0),
                one_of("opportunity_type", S.OPPORTUNITIES)]
    if table == "calendar":
        return [*map(required, ("topic", "week", "content_type", "primary_keyword", "secondary_keywords", "cluster_id",
                                "estimated_effort_hours", "priority")), within("week", 1, 52), list_size("secondary_keywords", 3, 6),
                at_least("estimated_effort_hours", 0), one_of("priority", S.PRIORITIES),
                one_of("content_type", S.CONTENT_TYPES)]
    if table == "link":
        return [*map(required, ("anchor_text", "url", "relevance_score")), http_url("url"), within("relevance_score", 0, 1)]
    if table == "faq":
        count = word_count("answer")
        return [required("question"), required("answer"), Rule("answer", "words_min_30", count >= 30, count.cast("string"))]
    if table == "brief":
        return [*map(required, ("topic", "primary_keyword", "secondary_keywords", "content_type", "target_url", "h1", "page_title",
                                "meta_description", "key_takeaways", "internal_links", "audience", "tone", "pov", "cta",
                                "headings_outline", "faqs")),
                list_size("secondary_keywords", 3, 6), text_length("page_title", 0, 60),
                text_length("meta_description", 120, 160), list_size("key_takeaways", 3, 5),
                list_size("internal_links", 3), list_size("faqs", 4, 4), one_of("tone", S.TONES),
                one_of("pov", S.POINTS_OF_VIEW), one_of("content_type", S.CONTENT_TYPES),
                every_item("internal_links", "link_url", lambda x: is_http_url(x["url"])),
                every_item("internal_links", "relevance_0_1", lambda x: x["relevance_score"].between(0, 1)),
                every_item("faqs", "answer_words_min_30", lambda x: _min_words(x["answer"], 30))]
    if table == "crawl":
        return [required("url"), http_url("url"), required("text_content"), required("word_count"),
                required("status_code")]
    if table == "job":
        return [required("job_id"), required("url"), http_url("url"), within("progress", 0, 100),
                one_of("status", S.JOB_STATUSES)]
    if table == "config":
        return [at_least("max_pages", 1), at_least("crawl_delay", 0.5), at_least("max_concurrent_crawls", 1),
                at_least("min_search_volume", 0), within("max_ads_competition", 0, 1),
                within("max_difficulty", 0, 100), at_least("min_cluster_size", 2),
                one_of("clustering_method", ("hdbscan", "agglomerative", "bertopic")),
                at_least("calendar_weeks", 1), within("nli_threshold", 0, 1),
                one_of("export_format", ("excel", "csv", "json"))]
    raise ValueError(f"no rules for {table}")


def validate(df: DataFrame, rules: Sequence[Rule], key: str, table: str = "") -> DataFrame:
    """Violations ``table, key, field, rule, value``: all rules in one scan, no shuffle."""
    # A failing rule gives a struct, a passing one NULL, so shown values are only built for failures.
    failed = F.array_compact(F.array(*[
        F.when(~r.ok, F.struct(F.lit(r.field).alias("field"), F.lit(r.name).alias("rule"), r.value.alias("value")))
        for r in rules]))
    return df.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("key"),
                     F.explode(failed).alias("_f")).select(
        "table", "key", F.col("_f.field").alias("field"), F.col("_f.rule").alias("rule"),
        F.col("_f.value").alias("value"))


def rule_counts(df: DataFrame, rules: Sequence[Rule], table: str = "") -> DataFrame:
    """Passed and failed rows per rule: ``table, field, rule, passed, failed``.

    All rules are summed in one row per task before one tiny shuffle.
    """
    sums = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count(F.when(~r.ok, F.lit(1))).alias(f"_f{i}") for i, r in enumerate(rules)])
    lines = F.array(*[
        F.struct(F.lit(table).alias("table"), F.lit(r.field).alias("field"), F.lit(r.name).alias("rule"),
                 (F.col("_rows") - F.col(f"_f{i}")).alias("passed"), F.col(f"_f{i}").alias("failed"))
        for i, r in enumerate(rules)])
    return sums.select(F.inline(lines))


def with_defaults(requests: DataFrame, locale: str = "en-GB") -> DataFrame:
    """Job requests with trimmed text and the default locale filled in."""
    return requests.withColumn("url", F.trim("url")).withColumn(
        "locale", F.coalesce(F.nullif(F.trim("locale"), F.lit("")), F.lit(locale)))
