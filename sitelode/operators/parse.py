"""Raw pages to parsed columns and child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html as H, urls as U
from ..functions.text import let, or_default, word_count
from ..lexicons import LANGUAGE_STOPWORDS
from ..session import durable

LEVELS = ("h2", "h3", "h4")


def _of_level(elements: Column, level: str) -> Column:
    same = F.call_function("filter", elements, F.expr(f"he -> lower(substr(he, 2, 2)) = '{level}'"))
    return F.call_function("transform", same, F.expr(f"he -> {H.inner_text_sql('he')}"))


def page_headings(df: DataFrame, levels=LEVELS, site_col: str = "site_id") -> DataFrame:
    """One row per heading; ``pos`` counts from 0 within the level, in document order."""
    per_level = F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), _of_level(F.col("_found"), level).alias("texts")) for level in levels
    ]))
    return (
        df.select(site_col, "url", H.heading_elements("html").alias("_found"))
        .select(site_col, "url", per_level.alias("_g"))
        .select(site_col, "url", F.col("_g.level").alias("level"), F.posexplode("_g.texts").alias("pos", "text"))
    )


def headings_map(html, cleaned: bool = False) -> Column:
    """Level to texts; all three levels are always present."""
    found = H.heading_elements(html, cleaned)
    return F.create_map(*[x for level in LEVELS for x in (F.lit(level), _of_level(found, level))])


def page_links(df: DataFrame, site_col: str = "site_id") -> DataFrame:
    """Every ``<a href>`` resolved against its page; duplicates and fragments are kept.

    ``link_class`` is internal, external or NULL (mailto:, javascript:, tel: and the like).
    """
    base = F.col("_base")
    return (
        df.select(site_col, "url", U.url_parts("url").alias("_base"),
                  F.posexplode(H.attribute_values(H.link_tags("html"), "href")).alias("pos", "href"))
        .withColumn("target", U.url_join("url", "href", base))
        .withColumn("link_class", U.link_class("target", "url", base))
        .drop("_base")
    )


def page_images(df: DataFrame, site_col: str = "site_id") -> DataFrame:
    """Every ``<img src>`` resolved against its page."""
    return (
        df.select(site_col, "url", F.posexplode(H.attribute_values(H.image_tags("html"), "src")).alias("pos", "src"))
        .withColumn("src", U.url_join("url", "src"))
    )


def page_blocks(df: DataFrame, site_col: str = "site_id", max_link_share: float = 0.5) -> DataFrame:
    """Main-text blocks of every page, repeats within the page removed."""
    return df.select(site_col, "url", F.posexplode(H.main_blocks("html", max_link_share)).alias("pos", "text"))


def main_text(df: DataFrame, target_language: str | None = None, max_link_share: float = 0.5) -> DataFrame:
    """Adds ``text_content``: body blocks, or all visible text when none is left.

    An approximation of article extraction (see ``main_blocks``). With ``target_language`` set, a page
    whose stop words point to another language also falls back to its visible text. All per row.
    """
    body = F.array_join(H.main_blocks("html", max_link_share), "\n")
    df = df.withColumn("_main", body)
    main = F.col("_main")
    if target_language:
        spoken = H.language_of(main, LANGUAGE_STOPWORDS)
        main = F.when(spoken.isNull() | (spoken == target_language), main)
    return df.withColumn(
        "text_content", F.coalesce(F.nullif(main, F.lit("")), H.visible_text("html"))
    ).drop("_main")


def drop_site_boilerplate(blocks: DataFrame, min_pages: int = 3, site_col: str = "site_id") -> DataFrame:
    """Remove blocks that occur on at least ``min_pages`` pages of a site.

    Page counts are pre-aggregated per (site, block digest, page); the removal is an anti-join on the
    128-bit digest, so no block text is shuffled for the count. Blocks are written once: pages are parsed once for both sides.
    """
    marked = durable(blocks.withColumn("_digest", F.unhex(F.md5("text"))))
    repeated = (
        marked.select(site_col, "_digest", "url").distinct()
        .groupBy(site_col, "_digest").agg(F.count(F.lit(1)).alias("_pages"))
        .filter(F.col("_pages") >= min_pages).select(site_col, "_digest")
    )
    return marked.join(repeated, [site_col, "_digest"], "left_anti").select(*blocks.columns)


def parse_pages(df: DataFrame, article_text: bool = True, target_language: str | None = None,
                crawled_at: Column | None = None, site_col: str = "site_id") -> DataFrame:
    """Full page record. ``article_text=False`` uses visible text only.

    A source ``status`` column is carried through; otherwise 200 is recorded, as stored pages are
    successful downloads.
    """
    status = F.col("status") if "status" in df.columns else F.lit(200)
    seq = F.col("crawl_seq") if "crawl_seq" in df.columns else F.lit(None).cast("bigint")
    if article_text:
        df = main_text(df, target_language)
    else:
        df = df.withColumn("text_content", H.visible_text("html"))
    base = F.col("_base")
    df = df.withColumn("_markup", H.markup("html")).withColumn("_base", U.url_parts("url"))

    def resolve(href: Column) -> Column:
        return let(U.url_join("url", href, base), lambda t: F.struct(
            t.alias("target"), U.link_class(t, F.col("url"), base).alias("kind")))

    df = df.withColumn("_links", F.transform(H.attribute_values(H.link_tags("_markup", True), "href"), resolve))

    def links_of(kind: str) -> Column:
        chosen = F.filter("_links", lambda x: F.coalesce(x["kind"] == kind, F.lit(False)))
        return F.transform(chosen, lambda x: x["target"])

    images = F.transform(H.attribute_values(H.image_tags("_markup", True), "src"), lambda s: U.url_join("url", s, base))
    return df.select(
        site_col, seq.cast("bigint").alias("crawl_seq"), "url", status.cast("int").alias("status_code"),
        H.page_title("_markup", True).alias("title"), H.meta_description("_markup", True).alias("meta_description"),
        H.first_h1("_markup", True).alias("h1"), headings_map("_markup", True).alias("headings"),
        or_default("text_content", "").alias("text_content"),
        links_of("internal").alias("internal_links"), links_of("external").alias("external_links"),
        images.alias("images"), word_count("text_content").cast("int").alias("word_count"),
        (crawled_at if crawled_at is not None else F.lit(None).cast("timestamp")).alias("crawled_at"),
    )
