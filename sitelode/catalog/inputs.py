"""Engine inputs derived from the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.urls import url_part
from ..session import spread
from ..sources import read_pages, site_pages, text_pages
from ..streaming.jobs import stage_progress


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = {"documents": "doc_id", "pages": "page_id"}.get(name)
    return spread(df, key) if key else df


def stream_path(sf_dir: str, name: str) -> str:
    """A table as the path of a file stream: a pattern, since a stream takes a plain path for a folder and a table may be one file."""
    return f"{sf_dir}/{{{name}.parquet}}"


# --- stored pages --------------------------------------------------------------------------------

def pages(spark, sf_dir) -> DataFrame:
    return site_pages(spread(read_pages(spark, f"{sf_dir}/pages.parquet"), "page_id"))


PAGES = """p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site_id, page_id AS crawl_seq, url, html
  FROM pages WHERE html IS NOT NULL AND html <> '')"""

# SQL text of a page: scripts, styles, comments and tags to blanks, entities, white space collapsed.
def sql_text(html: str) -> str:
    shown = f"regexp_replace({html}, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g')"
    shown = f"regexp_replace({shown}, '<[/!A-Za-z][^>]*>', ' ', 'g')"
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        shown = f"replace({shown}, '{name}', '{char}')"
    return f"trim(regexp_replace({shown}, '\\s+', ' ', 'g'))"


TEXTS = PAGES + f""", t AS (SELECT site_id, crawl_seq, url, {sql_text('html')} AS text_content FROM p)"""


# --- documents as parsed pages and as HTML -------------------------------------------------------

def docs(spark, sf_dir) -> DataFrame:
    return text_pages(table(spark, sf_dir, "documents"))


DOCS = """d AS (SELECT source AS site_id, doc_id AS crawl_seq, 'https://' || source || '.example.com/' || doc_id AS url,
  text AS text_content FROM documents)"""


def lang_docs(spark, sf_dir) -> DataFrame:
    """Documents with one site per source and language and the language in the URL path."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("-", "source", "lang").alias("site_id"), F.col("doc_id").alias("crawl_seq"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/our_page-"),
                 F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("text_content"))


LANG_DOCS = """g AS (SELECT source || '-' || lang AS site_id, doc_id AS crawl_seq,
  'https://' || source || '.example.com/' || lang || '/our_page-' || doc_id AS url, text AS text_content FROM documents)"""


def _escape(text):
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(ref))
    return text


def doc_html(spark, sf_dir) -> DataFrame:
    """Documents as HTML pages: title, description and h1 from the first line, then each line as
    heading, paragraph, image or link in turn."""
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    first = _escape(F.get(lines, F.lit(0)))

    def element(line, i):
        text, n = _escape(line), i.cast("string")
        return (
            F.when(i % 4 == 0, F.concat(F.lit("<h2>"), text, F.lit("</h2>")))
            .when(i % 4 == 1, F.concat(F.lit("<p>"), text, F.lit(" <a title='a > b' href=\"../s-"), n,
                                       F.lit("?a=1&amp;b=2\">more</a><br>")))
            .when(i % 4 == 2, F.concat(F.lit('<h3 class="t">'), text, F.lit('</h3><img alt=">" src="img/'), n,
                                       F.lit('.png">')))
            .otherwise(F.concat(F.lit("<H4>"), text, F.lit("</H4><a href='https://o.example.net:81/"), n,
                                F.lit("'>out</a><a href=mailto:x@y.z>mail</a>")))
        )

    html = F.concat(
        F.lit("<!DOCTYPE html><html><!-- <title>none</title> --><head><title>"), first,
        F.lit("</title><meta name='viewport' content='x'><meta content=\""), first,
        F.lit("\" name=\"description\"><style>h2{}</style></head><body><h1> "), first,
        F.lit(" <b>doc</b></h1><script>var s='<h2>no</h2>';</script>"),
        F.array_join(F.transform(lines, element), ""), F.lit("</body></html>"))
    return d.select(
        F.col("source").alias("site_id"), F.col("doc_id").alias("crawl_seq"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string"),
                 F.lit("/page?q=1#top")).alias("url"), html.alias("html"))


# One row per document line, 1-based ``i``.
DOC_LINES = """h AS (SELECT source AS site_id, doc_id AS crawl_seq, lang,
  'https://' || source || '.example.com/' || lang || '/' || doc_id || '/page?q=1#top' AS url,
  string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT site_id, crawl_seq, url, lang, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM h)"""


# --- robots.txt and sitemaps ---------------------------------------------------------------------

def robots(spark, sf_dir) -> DataFrame:
    """One robots.txt per host, built from the paths stored for the host; some hosts answer 404."""
    per_host = pages(spark, sf_dir).groupBy("site_id").agg(
        F.min(url_part("url", "PATH")).alias("low"), F.max("crawl_seq").alias("last"), F.count(F.lit(1)).alias("n"))
    body = F.concat(
        F.lit("User-agent: badbot\nDisallow: /\n\n# main group\nUSER-AGENT : *\nCrawl-delay: 5\nDisallow: "), "low",
        F.lit("\nAllow: /en%2F # english\nDisallow: /"), F.when(F.col("n") > 3, "fr").otherwise(""),
        F.lit("\nSitemap: https://"), "site_id", F.lit("/sm-"), F.col("last").cast("string"),
        F.lit(".xml\n\nUser-agent: *\nDisallow: /de\n"))
    return per_host.select(
        F.col("site_id").alias("host"), F.when(F.col("site_id").startswith("m."), 404).otherwise(200).alias("status"),
        body.alias("body"))


ROBOTS = PAGES + """, per_host AS (SELECT site_id AS host, min(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS low,
  max(crawl_seq) AS last, count(*) AS n FROM p GROUP BY 1),
rules AS (SELECT host, unnest([1, 2, 3]) AS seq, unnest([false, true, false]) AS allow,
  unnest([low, '/en/', CASE WHEN n > 3 THEN '/fr' ELSE '/' END]) AS prefix FROM per_host WHERE host NOT LIKE 'm.%')"""


def sitemaps(spark, sf_dir) -> DataFrame:
    """One sitemap per page; the page stored first for a host has the host's default location."""
    p = pages(spark, sf_dir)
    first = p.groupBy("site_id").agg(F.min("crawl_seq").alias("crawl_seq")).withColumn("default", F.lit(True))
    placed = p.join(first, ["site_id", "crawl_seq"], "left")
    number = F.col("crawl_seq").cast("string")
    name = F.when(F.col("default"), F.lit("/sitemap.xml")).otherwise(F.concat(F.lit("/sm-"), number, F.lit(".xml")))
    body = F.concat(
        F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>\n '),
        _escape(F.col("url")), F.lit(" </loc></url><url><loc><![CDATA[https://"), "site_id", F.lit("/x?a=1&b="), number,
        F.lit("]]></loc></url></urlset>"))
    return placed.select(F.concat(F.lit("https://"), "site_id", name).alias("sitemap_url"), body.alias("body"))


SITEMAPS = ROBOTS + """, firsts AS (SELECT site_id, min(crawl_seq) AS f FROM p GROUP BY 1),
sm AS (SELECT p.site_id, 'https://' || p.site_id || CASE WHEN crawl_seq = f THEN '/sitemap.xml'
  ELSE '/sm-' || crawl_seq || '.xml' END AS sitemap_url, unnest([url, 'https://' || p.site_id || '/x?a=1&b=' || crawl_seq]) AS url
  FROM p JOIN firsts USING (site_id))"""


# --- link graph ----------------------------------------------------------------------------------

def edges(spark, sf_dir) -> DataFrame:
    """Per host, the page stored at rank i links to those at ranks 2i and 2i + 1."""
    from ..operators.ranking import rank_rows

    ranked = rank_rows(pages(spark, sf_dir).select("site_id", "crawl_seq", "url"), ["site_id"], ["crawl_seq"], "i")
    src = ranked.select("site_id", F.col("url").alias("src"), F.explode(
        F.array(F.col("i") * 2, F.col("i") * 2 + 1)).alias("i"))
    return src.join(ranked.select("site_id", "i", F.col("url").alias("dst")), ["site_id", "i"]).select(
        "site_id", "src", "dst", (F.col("i") % 2).alias("pos"))


EDGES = """ranked AS (SELECT site_id, url, row_number() OVER (PARTITION BY site_id ORDER BY crawl_seq) AS i FROM p),
edges AS (SELECT a.site_id, a.url AS src, b.url AS dst FROM ranked a JOIN ranked b
  ON a.site_id = b.site_id AND (b.i = 2 * a.i OR b.i = 2 * a.i + 1))"""


# --- keywords, ranks -----------------------------------------------------------------------------

def _sold(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_brand", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("term"), "p_size")
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey")


def keywords(spark, sf_dir) -> DataFrame:
    """Keyword table: brand as site, product phrases as terms, order lines as search volume."""
    def percent(col: str):
        return F.sum(F.round(F.col(col) * 100).cast("long"))

    n = F.count(F.lit(1))
    agg = _sold(spark, sf_dir).groupBy(F.col("p_brand").alias("site_id"), "term").agg(
        n.cast("int").alias("volume"), (percent("l_discount") / n / 10).alias("ads_competition"),
        (percent("l_tax") / n * 10).alias("difficulty_proxy"), F.max("p_size").alias("_size"))
    intent = F.element_at(F.array(*[F.lit(x) for x in ("informational", "commercial", "transactional", "navigational")]),
                          F.col("_size") % 4 + 1)
    return agg.select(
        "site_id", "term", "volume", "ads_competition", F.lit(None).cast("double").alias("cpc"), intent.alias("intent"),
        F.array().cast("array<string>").alias("serp_features"), F.lit(False).alias("verified_against_site"),
        F.lit(None).cast("string").alias("cannot_verify_note"), F.lit(0.0).alias("score"),
        F.split_part("term", F.lit(" "), F.lit(2)).alias("cluster_id"), F.lit(False).alias("is_primary"), "difficulty_proxy")


KEYWORDS = """k AS (SELECT p_brand AS site_id, p_name || ' ' || lower(p_type) AS term, count(*)::INTEGER AS volume,
  sum(round(l_discount * 100)::BIGINT)::BIGINT / count(*) / 10 AS ads_competition,
  sum(round(l_tax * 100)::BIGINT)::BIGINT / count(*) * 10 AS difficulty_proxy,
  (['informational', 'commercial', 'transactional', 'navigational'])[max(p_size) % 4 + 1] AS intent,
  split_part(p_name || ' ' || lower(p_type), ' ', 2) AS cluster_id
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, p_name, p_type)"""


def ranks(spark, sf_dir) -> DataFrame:
    """Position of each nation's suppliers for each product phrase by quantity sold: one row per pair."""
    from pyspark.sql import Window

    supplier = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.lower("n_name").alias("domain"))
    sums = _sold(spark, sf_dir).join(supplier, "l_suppkey").groupBy(F.col("term").alias("keyword"), "domain").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("q"))
    # One row per nation and phrase, so a window holds at most as many rows as there are nations.
    best_first = Window.partitionBy("keyword").orderBy(F.desc("q"), "domain")
    return sums.withColumn("position", F.row_number().over(best_first)).select("domain", "keyword", "position")


RANKS = """sums AS (SELECT p_name || ' ' || lower(p_type) AS keyword, lower(n_name) AS domain, sum(l_quantity)::BIGINT AS q
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey GROUP BY p_name, p_type, n_name),
r AS (SELECT domain, keyword, row_number() OVER (PARTITION BY keyword ORDER BY q DESC, domain) AS position FROM sums)"""


# --- job log -------------------------------------------------------------------------------------

# Event type to job status.
STATUS = {"signup": "crawling", "click": "analyzing", "view": "researching", "purchase": "completed", "error": "failed"}


def job_log(spark, sf_dir) -> DataFrame:
    return to_job_log(table(spark, sf_dir, "events"))


def to_job_log(events: DataFrame) -> DataFrame:
    """Events as a status log: user as job, event type as status."""
    names = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    status = F.try_element_at(names, F.col("event_type"))
    return events.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"),
        stage_progress(status).cast("double").alias("progress"),
        F.when(status == "failed", F.get_json_object("props", "$.k")).alias("error"), F.col("ts").alias("updated_at"))


JOB_LOG = """j AS (SELECT user_id::VARCHAR AS job_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'crawling'
  WHEN 'click' THEN 'analyzing' WHEN 'view' THEN 'researching' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
  CASE event_type WHEN 'signup' THEN 20.0 WHEN 'click' THEN 30.0 WHEN 'view' THEN 40.0 WHEN 'purchase' THEN 100.0 END::DOUBLE AS progress,
  CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') END AS error, ts AS updated_at FROM events)"""


def jobs(spark, sf_dir) -> DataFrame:
    """One job per customer."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("job_id"),
        F.concat(F.lit("https://"), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit(".example.com")).alias("url"),
        F.lit("en-GB").alias("locale"), F.lower("c_mktsegment").alias("status"),
        F.round(F.col("c_acctbal") / 100, 2).alias("progress"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))


JOBS = """c AS (SELECT c_custkey::VARCHAR AS job_id, 'https://' || lower(replace(c_name, '#', '-')) || '.example.com' AS url,
  lower(c_mktsegment) AS status, round(c_acctbal / 100, 2) AS progress, TIMESTAMP '2024-01-01' AS created_at FROM customer)"""


# --- briefs, drafts, calendar --------------------------------------------------------------------

def briefs(spark, sf_dir) -> DataFrame:
    """One brief per document, its lines as list items, numbered per source by topic; sections vary by language."""
    from ..operators.ranking import number_rows

    # Numbered as documents: what briefs say of a text is several times as long.
    d = number_rows(table(spark, sf_dir, "documents").select(
        F.col("source").alias("site_id"), "doc_id", "lang", "text",
        F.concat_ws(" ", F.lit("Plan &"), "lang", F.col("doc_id").cast("string")).alias("topic")), ["topic"])
    lines = F.split("text", "\n")
    none = F.array().cast("array<string>")
    tone = F.when(F.col("lang") == "en", "professional").when(F.col("lang") == "de", "academic").otherwise("plain")
    base = F.concat(F.lit("https://"), "site_id", F.lit(".example.com/"))
    return d.select(
        "site_id", "doc_id", "topic", F.col("lang").alias("primary_keyword"),
        F.transform(lines, lambda x: F.split_part(x, F.lit(" "), F.lit(1))).alias("secondary_keywords"),
        F.lit("blog").alias("content_type"), base.alias("target_url"), F.concat(F.lit("H "), "site_id").alias("h1"),
        F.get(lines, F.lit(0)).alias("page_title"), F.get(lines, F.lit(0)).alias("meta_description"),
        lines.alias("key_takeaways"), F.when(F.col("lang") == "de", lines).otherwise(none).alias("definitions"),
        F.when(F.col("lang") == "fr", lines).otherwise(none).alias("key_stats"),
        F.when(F.col("lang") == "es", lines).alias("decision_tips"),
        F.transform(lines, lambda x, i: F.struct(
            F.concat(base, i.cast("string")).alias("url"), F.lit("see").alias("anchor_text"),
            (i / 8).cast("double").alias("relevance_score"))).alias("internal_links"),
        F.lit("readers").alias("audience"), tone.alias("tone"), F.lit("third_person").alias("pov"),
        F.lit(800).alias("word_count_min"), F.lit(1200).alias("word_count_max"),
        F.array().cast("array<struct<name:string,url:string>>").alias("sources"), F.lit("Call us").alias("cta"),
        none.alias("restrictions"), F.array(F.col("lang")).alias("requirements"),
        F.transform(lines, lambda x, i: F.struct(
            F.concat(F.lit("h"), (i % 4 + 1).cast("string")).alias("level"), x.alias("text"))).alias("headings_outline"),
        F.transform(lines, lambda x, i: F.struct(
            F.concat(F.lit("Q"), i.cast("string")).alias("question"), x.alias("answer"))).alias("faqs"), "idx")


BRIEFS = """b AS (SELECT source AS site_id, doc_id, 'Plan & ' || lang || ' ' || doc_id AS topic, lang, source,
  string_split(text, chr(10)) AS lines FROM documents)"""


def drafts(spark, sf_dir) -> DataFrame:
    """One draft per document, numbered per source by the document id."""
    from ..operators.ranking import number_rows

    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("site_id"), F.col("doc_id"),
        F.concat_ws(" ", F.lit("Plan &"), "lang", F.col("doc_id").cast("string")).alias("brief_id"), F.col("text").alias("content"),
        F.col("n_chars").cast("int").alias("word_count"), (F.col("n_chars") / 8).alias("readability_score"),
        (F.col("lang") == "en").alias("uk_english_verified"), F.lit(False).alias("facts_verified"),
        F.lit("2024-05-06 07:08:09").cast("timestamp").alias("created_at"))
    return number_rows(d, ["doc_id"])


def calendar(spark, sf_dir) -> DataFrame:
    """One calendar item per order, numbered per group of customers."""
    from ..operators.ranking import number_rows

    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string")).alias("site_id"),
        F.weekofyear("o_orderdate").alias("week"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("topic"),
        F.when(F.col("o_orderstatus") == "F", "blog").when(F.col("o_orderstatus") == "O", "service").otherwise("landing")
        .alias("content_type"), F.lower("o_orderstatus").alias("primary_keyword"),
        F.split(F.lower("o_orderpriority"), "[- ]").alias("secondary_keywords"), F.col("o_orderpriority").alias("cluster_id"),
        F.lit(4.0).alias("estimated_effort_hours"),
        F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 100000, "medium").otherwise("low").alias("priority"),
        F.col("o_orderkey"))
    return number_rows(o, ["o_orderkey"])


CALENDAR = """cal AS (SELECT 'src' || (o_custkey % 20) AS site_id, week(o_orderdate)::INTEGER AS week, 'Order ' || o_orderkey AS topic,
  CASE o_orderstatus WHEN 'F' THEN 'blog' WHEN 'O' THEN 'service' ELSE 'landing' END AS content_type,
  lower(o_orderstatus) AS primary_keyword, regexp_split_to_array(lower(o_orderpriority), '[- ]') AS secondary_keywords,
  o_orderpriority AS cluster_id, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END AS priority,
  row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey)::BIGINT AS idx FROM orders)"""
