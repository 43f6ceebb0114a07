"""Reports, briefs and drafts rendered as rows; writing them is a separate, thin step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.urls import url_part
from ..operators.ranking import first_pages, top_n
from ..operators.reports import cluster_sizes, crawl_report

LIST_STATE = "array<string>"


def _page_list(pages: DataFrame, n: int) -> DataFrame:
    """First ``n`` pages per site as one ordered array: bounded by ``n``, cut before the shuffle."""
    head = first_pages(pages.select("site_id", "crawl_seq", "url", "title", "word_count"), n)
    entry = F.struct("url", "title", F.col("word_count").cast("int").alias("word_count"))
    rows = F.array_sort(F.collect_list(F.struct("crawl_seq", entry.alias("page"))))
    return head.groupBy("site_id").agg(F.transform(rows, lambda r: r["page"]).alias("pages"))


def crawl_report_json(pages: DataFrame, n: int = 50) -> DataFrame:
    """``site_id, content``: totals and the first ``n`` pages of each site as JSON."""
    return crawl_report(pages).join(_page_list(pages, n), "site_id").select(
        "site_id", T.to_json_record("pages_crawled", "total_words", "pages").alias("content"))


def business_json(entity: DataFrame) -> DataFrame:
    """``site_id, content``: the business record of each site as JSON."""
    fields = [c for c in entity.columns if c != "site_id"]
    return entity.select("site_id", T.to_json_record(*fields).alias("content"))


def keywords_csv(keywords: DataFrame) -> DataFrame:
    """All keyword fields, arrays as JSON text so that CSV can hold them."""
    arrays = {f.name for f in keywords.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    return keywords.select(*[F.to_json(c).alias(c) if c in arrays else F.col(c) for c in keywords.columns])


def clusters_json(clusters: DataFrame, keywords: DataFrame) -> DataFrame:
    """``site_id, id, content``: id, label, pillar, total volume and member count of each cluster of each site."""
    sizes = cluster_sizes(keywords).withColumnRenamed("cluster_id", "id")
    counted = clusters.drop("members_count").join(sizes, ["site_id", "id"], "left").withColumn(
        "members_count", F.coalesce("members_count", F.lit(0)))
    return counted.select("site_id", "id", T.to_json_record("id", "label", "pillar", "total_volume", "members_count").alias("content"))


def _facet_arrays(facets: DataFrame, cut: dict[str, int | None]) -> DataFrame:
    """``site_id`` and one sorted array per facet, of its first values where a number is given: cut before they are gathered."""
    rows = facets.filter(F.col("facet").isin(*cut)).select("site_id", "facet", "value").distinct()
    limited = [f for f, n in cut.items() if n is not None]
    kept = rows.filter(~F.col("facet").isin(*limited))
    for n in sorted({cut[f] for f in limited}):
        some = [f for f in limited if cut[f] == n]
        kept = kept.unionByName(top_n(rows.filter(F.col("facet").isin(*some)), ["site_id", "facet"], ["value"], n))
    return kept.groupBy("site_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("facet") == f, F.col("value")))).alias(f) for f in cut])


def run_summary_json(pages: DataFrame, facets: DataFrame, sites: DataFrame, run_ts: Column, n_pages: int = 10,
                     n_values: int = 10) -> DataFrame:
    """``site_id, filename, content``: compact run summary, first pages and first services and products.

    ``facets`` is the long form (``site_id, facet, value``) and ``sites`` has ``site_id, name, homepage``.
    """
    cut = {"services": n_values, "products": n_values, "locations": None, "target_audiences": None}
    own = sites.join(_facet_arrays(facets, cut), "site_id", "left").select(
        "site_id", F.col("homepage").alias("site_url"), F.struct("name", *[
            F.coalesce(F.col(f), F.array().cast(LIST_STATE)).alias(f) for f in cut]).alias("business_analysis"))
    joined = crawl_report(pages).join(_page_list(pages, n_pages), "site_id").join(own, "site_id", "left")
    stamp = T.fmt(run_ts, "stamp")
    content = T.to_json_record(
        F.col("site_url").alias("url"), stamp.alias("timestamp"), "pages_crawled",
        F.col("pages").alias("crawl_summary"), "business_analysis")
    host = F.translate(url_part("site_url", "AUTHORITY"), ".", "_")
    return joined.select(
        "site_id", F.concat(F.lit("demo_results_"), host, F.lit("_"), stamp, F.lit(".json")).alias("filename"),
        content.alias("content"))


def _bullets(items: str) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit("- "), x))


def _lines(*texts) -> Column:
    return F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts])


def _optional(items: str, heading: str) -> Column:
    """Bullet section, left out when the list is empty or NULL."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0,
                  F.concat(_lines(heading, ""), _bullets(items), _lines(""))).otherwise(F.array().cast(LIST_STATE))


def _field(label: str, value) -> Column:
    return F.concat(F.lit(f"**{label}:** "), F.coalesce(value if isinstance(value, Column) else F.col(value), F.lit("None")))


def brief_markdown() -> Column:
    """A brief as Markdown. Section titles and their order."""
    link_row = F.transform("internal_links", lambda x: F.concat(
        F.lit("| "), x["url"], F.lit(" | "), x["anchor_text"], F.lit(" | "), T.fmt(x["relevance_score"], ".1f"),
        F.lit(" |")))
    marks = F.create_map(*[F.lit(x) for pair in (("h2", "## "), ("h3", "### "), ("h4", "#### ")) for x in pair])
    outline = F.transform(
        F.filter("headings_outline", lambda h: h["level"].isin("h2", "h3", "h4")),
        lambda h: F.concat(F.element_at(marks, h["level"]), h["text"]))
    questions = F.flatten(F.transform("faqs", lambda q: F.array(
        F.concat(F.lit("### "), q["question"]), F.lit(""), q["answer"], F.lit(""))))
    words = F.concat(F.col("word_count_min").cast("string"), F.lit("-"), F.col("word_count_max").cast("string"),
                     F.lit(" words"))
    sections = [
        _lines(F.concat(F.lit("# "), "topic", F.lit(" - Content Brief V2.0")), "", "---", ""),
        _lines("## Web Page Structure", "", _field("Target URL", "target_url"), _field("H1", "h1"),
               _field("Page Title", "page_title"), _field("Meta Description", "meta_description"), ""),
        _lines("## AI Optimisation", "", "### Key Takeaways", "*To appear directly under the H1*", ""),
        _bullets("key_takeaways"), _lines(""),
        _optional("definitions", "### Definitions"),
        _optional("key_stats", "### Key Statistics"),
        _optional("decision_tips", "### Decision Tips"),
        _lines("## Keywords", "", _field("Primary Keyword", "primary_keyword"),
               _field("Secondary Keywords", T.join_list("secondary_keywords")), ""),
        _lines("## Internal Linking", "", "| URL | Anchor Text | Relevance |", "|-----|-------------|-----------|"),
        link_row, _lines(""),
        _lines("## Writing Guidelines", "", _field("Target Audience", "audience"), _field("Tone", "tone"),
               _field("POV", "pov"), _field("Word Count", words), ""),
        _optional("requirements", "### Requirements"),
        _optional("restrictions", "### Restrictions"),
        _lines("## Suggested Headings", ""), outline, _lines(""),
        _lines("## Frequently Asked Questions", "*Must be the last section with exactly 4 FAQs*", ""), questions,
        _lines("## Call to Action", "", F.col("cta"), ""),
    ]
    return F.array_join(F.concat(*[F.coalesce(s, F.array().cast(LIST_STATE)) for s in sections]), "\n", "None")


def _numbered(df: DataFrame, table: str) -> DataFrame:
    """``df``, which must carry the calendar's positions: files of three tables are paired by them."""
    if "idx" not in df.columns:
        raise ValueError(f"{table} need the calendar's idx")
    return df


def _file_name(idx, text, kind: str) -> Column:
    return F.concat(T.fmt(idx, "03d"), F.lit("-"), T.slug(text), F.lit(f"-{kind}.md"))


def render_briefs(briefs: DataFrame) -> DataFrame:
    """``site_id, idx, topic, filename, content``; ``idx`` is the calendar item's position."""
    return _numbered(briefs, "briefs").select(
        "site_id", "idx", "topic", _file_name("idx", "topic", "brief").alias("filename"),
        brief_markdown().alias("content"))


# The front-matter keys are the output format.
def render_drafts(drafts: DataFrame) -> DataFrame:
    """``site_id, idx, brief_id, filename, word_count, content`` with a front-matter header."""
    def flag(name: str) -> Column:
        return F.initcap(F.col(name).cast("string"))

    content = F.concat(
        F.lit("---\nbrief_id: "), "brief_id", F.lit("\nword_count: "), F.col("word_count").cast("string"),
        F.lit("\nreadability_score: "), T.fmt("readability_score", ".2f"),
        F.lit("\nuk_english_verified: "), flag("uk_english_verified"),
        F.lit("\nfacts_verified: "), flag("facts_verified"),
        F.lit("\ncreated_at: "), T.fmt("created_at", "iso"), F.lit("\n---\n\n"), "content", F.lit("\n"))
    return _numbered(drafts, "drafts").select(
        "site_id", "idx", "brief_id", _file_name("idx", "brief_id", "draft").alias("filename"), "word_count",
        content.alias("content"))


def calendar_files(calendar: DataFrame, briefs: DataFrame, drafts: DataFrame) -> DataFrame:
    """Calendar rows with the brief and draft of the same position: ``idx`` pairs them, not the topic."""
    return (
        calendar.join(briefs.select("site_id", "idx", F.col("filename").alias("brief_file")), ["site_id", "idx"], "left")
        .join(drafts.select("site_id", "idx", F.col("filename").alias("draft_file"),
                            F.col("word_count").alias("draft_words")), ["site_id", "idx"], "left")
    )


def calendar_index(calendar: DataFrame, briefs: DataFrame, drafts: DataFrame) -> DataFrame:
    """The calendar index: one row per item with file names, link targets and word counts.

    ``briefs`` and ``drafts`` are rendered rows; missing files give empty text and 0 words.
    """
    paired = calendar_files(_numbered(calendar, "calendar items"), briefs, drafts)

    def link(folder: str, name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{folder}/"), name)).otherwise("")

    return paired.select(
        "site_id", "idx", "week", "topic", "content_type", "primary_keyword",
        T.join_list("secondary_keywords").alias("secondary_keywords"), F.col("cluster_id").alias("cluster"), "priority",
        F.coalesce("brief_file", F.lit("")).alias("brief_file"), F.coalesce("draft_file", F.lit("")).alias("draft_file"),
        F.coalesce("draft_words", F.lit(0)).alias("word_count"),
        link("briefs", "brief_file").alias("brief_link"), link("drafts", "draft_file").alias("draft_link"))


def client_layout(df: DataFrame, names: DataFrame, run_ts: Column) -> DataFrame:
    """Adds ``client_slug`` and ``run_ts``, the two folder levels of an export."""
    slugs = names.select("site_id", T.slug(T.or_default("name", "client")).alias("client_slug"))
    return df.join(slugs, "site_id", "left").withColumn(
        "client_slug", F.coalesce("client_slug", F.lit("client"))).withColumn("run_ts", T.fmt(run_ts, "stamp"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
