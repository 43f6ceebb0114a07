"""Page parsing."""

from pyspark.sql import functions as F

from ..functions import html as H, text as T, urls as U
from ..lexicons import LANGUAGE_STOPWORDS
from ..operators import parse as P
from ..operators.ranking import first_links, first_pages
from ..operators.reports import crawl_report
from ..operators.robots_filter import same_domain
from . import inputs as I
from .registry import query


@query(f"WITH {I.PAGES} SELECT site_id, crawl_seq, url, length(html) AS n_chars FROM p")
def stored_pages(spark, sf_dir):
    return I.pages(spark, sf_dir).select("site_id", "crawl_seq", "url", F.length("html").cast("long").alias("n_chars"))


@query(f"""WITH {I.TEXTS}, w AS (SELECT site_id, crawl_seq, CASE WHEN text_content = '' THEN 0 ELSE len(string_split(text_content, ' ')) END AS n FROM t)
SELECT site_id, count(*) AS pages_crawled, sum(n)::BIGINT AS total_words, max(n)::BIGINT AS longest_page FROM w GROUP BY site_id""")
def site_report(spark, sf_dir):
    """Pages, words and longest page per site: the flagship query."""
    p = I.pages(spark, sf_dir).select("site_id", T.word_count(H.visible_text("html")).cast("long").alias("word_count"))
    longest = F.max("word_count").alias("longest_page")
    return p.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages_crawled"), F.sum("word_count").alias("total_words"), longest)


@query(f"""WITH {I.PAGES} SELECT crawl_seq, replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&') AS title FROM p""")
def page_titles(spark, sf_dir):
    return I.pages(spark, sf_dir).select("crawl_seq", H.page_title("html").alias("title"))


@query("SELECT doc_id AS crawl_seq, string_split(text, chr(10))[1] AS title, string_split(text, chr(10))[1] AS description FROM documents")
def meta_descriptions(spark, sf_dir):
    return I.doc_html(spark, sf_dir).select(
        "crawl_seq", H.page_title("html").alias("title"), H.meta_description("html").alias("description"))


@query("SELECT doc_id AS crawl_seq, string_split(text, chr(10))[1] || 'doc' AS h1 FROM documents")
def first_headings(spark, sf_dir):
    return I.doc_html(spark, sf_dir).select("crawl_seq", H.first_h1("html").alias("h1"))


@query(f"""WITH {I.DOC_LINES} SELECT site_id, url, 'h' || (CASE i % 4 WHEN 0 THEN 2 WHEN 2 THEN 3 ELSE 4 END) AS level, i // 4 AS pos, line AS text
FROM l WHERE i % 4 <> 1""")
def page_headings(spark, sf_dir):
    return P.page_headings(I.doc_html(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


_LINK_ROWS = f"""WITH {I.DOC_LINES},
x AS (SELECT site_id, url, crawl_seq, lang, i, 0 AS k, '../s-' || i || '?a=1&b=2' AS href,
  'https://' || site_id || '.example.com/' || lang || '/s-' || i || '?a=1&b=2' AS target, 'internal' AS link_class FROM l WHERE i % 4 = 1
UNION ALL SELECT site_id, url, crawl_seq, lang, i, 0, 'https://o.example.net:81/' || i, 'https://o.example.net:81/' || i, 'external' FROM l WHERE i % 4 = 3
UNION ALL SELECT site_id, url, crawl_seq, lang, i, 1, 'mailto:x@y.z', 'mailto:x@y.z', NULL FROM l WHERE i % 4 = 3),
links AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY i, k) - 1 AS pos FROM x)"""


@query(f"{_LINK_ROWS} SELECT site_id, url, pos, href, target, link_class FROM links")
def page_links(spark, sf_dir):
    return P.page_links(I.doc_html(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {I.PAGES}, a AS (SELECT site_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM p),
u AS (SELECT site_id, url, unnest(hs) AS href, unnest(range(len(hs))) AS pos FROM a)
SELECT site_id, url, pos, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || href AS target FROM u""")
def stored_page_links(spark, sf_dir):
    return P.page_links(I.pages(spark, sf_dir)).select("site_id", "url", F.col("pos").cast("long").alias("pos"), "target")


@query(f"{_LINK_ROWS} SELECT site_id, coalesce(link_class, 'dropped') AS link_class, count(*) AS n FROM links GROUP BY 1, 2")
def link_classes(spark, sf_dir):
    links = P.page_links(I.doc_html(spark, sf_dir))
    return links.groupBy("site_id", F.coalesce("link_class", F.lit("dropped")).alias("link_class")).agg(
        F.count(F.lit(1)).alias("n"))


@query(f"{_LINK_ROWS} SELECT url, count(*) AS n FROM links WHERE link_class = 'internal' GROUP BY url")
def same_domain_links(spark, sf_dir):
    return same_domain(P.page_links(I.doc_html(spark, sf_dir))).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {I.DOC_LINES} SELECT site_id, url, i // 4 AS pos,
'https://' || site_id || '.example.com/' || lang || '/' || crawl_seq || '/img/' || i || '.png' AS src FROM l WHERE i % 4 = 2""")
def page_images(spark, sf_dir):
    return P.page_images(I.doc_html(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {I.TEXTS} SELECT site_id, crawl_seq, text_content FROM t")
def visible_texts(spark, sf_dir):
    return I.pages(spark, sf_dir).select("site_id", "crawl_seq", H.visible_text("html").alias("text_content"))


_MAIN = f"""WITH {I.PAGES}, body AS (SELECT site_id, crawl_seq, url, unnest(regexp_split_to_array(regexp_replace(html,
  '(?is)<!--.*?-->|<head>.*?</head>|<script[^>]*>.*?</script>|<nav>.*?</nav>|<footer>.*?</footer>|<div class="ad">.*?</div>', '<br>', 'g'),
  '(?i)</?(?:p|h1|article|body|html|br)(?:\\s[^>]*)?>')) AS piece, generate_subscripts(regexp_split_to_array(regexp_replace(html,
  '(?is)<!--.*?-->|<head>.*?</head>|<script[^>]*>.*?</script>|<nav>.*?</nav>|<footer>.*?</footer>|<div class="ad">.*?</div>', '<br>', 'g'),
  '(?i)</?(?:p|h1|article|body|html|br)(?:\\s[^>]*)?>'), 1) AS k FROM p),
piece_text AS (SELECT site_id, crawl_seq, url, k, {I.sql_text('piece')} AS text FROM body),
blocks AS (SELECT site_id, crawl_seq, url, text, min(k) AS k FROM piece_text WHERE text <> '' GROUP BY ALL)"""


@query(f"""{_MAIN}, main AS (SELECT crawl_seq, string_agg(text, chr(10) ORDER BY k) AS main FROM blocks GROUP BY 1)
SELECT crawl_seq, coalesce(main, {I.sql_text('html')}) AS text_content FROM p LEFT JOIN main USING (crawl_seq)""")
def main_texts(spark, sf_dir):
    return P.main_text(I.pages(spark, sf_dir)).select("crawl_seq", "text_content")


@query(f"""{_MAIN}, main AS (SELECT crawl_seq, string_agg(text, chr(10) ORDER BY k) AS main FROM blocks GROUP BY 1)
SELECT crawl_seq, coalesce(main, '') AS text_content FROM p LEFT JOIN main USING (crawl_seq)""")
def nested_main_texts(spark, sf_dir):
    """Main blocks of the pages with a menu inside a menu and boxes inside an advert put before every paragraph: the same as without."""
    nested = ('<nav><ul><li>menu</li></ul><nav>inner</nav>still menu</nav>'
              '<div class="ad"><div><div>offer</div>more</div>still offer</div><p')
    pages = I.pages(spark, sf_dir).withColumn("html", F.regexp_replace("html", r"<p(?=[\s>])", nested))
    return pages.select("crawl_seq", F.array_join(H.main_blocks("html"), "\n").alias("text_content"))


def _hits(lang: str) -> str:
    listed = ", ".join(f"'{w}'" for w in LANGUAGE_STOPWORDS[lang])
    return f"len(list_filter(regexp_split_to_array(lower(main), '\\s+'), lambda w: w IN ({listed})))"


@query(f"""{_MAIN}, main AS (SELECT crawl_seq, string_agg(text, chr(10) ORDER BY k) AS main FROM blocks GROUP BY 1),
scored AS (SELECT crawl_seq, main, {", ".join(f"{_hits(x)} AS {x}" for x in sorted(LANGUAGE_STOPWORDS))} FROM main),
gated AS (SELECT crawl_seq, CASE WHEN greatest(de, en, es, fr) = 0 OR (en > de AND en >= es AND en >= fr) THEN main END AS main FROM scored),
chosen AS (SELECT crawl_seq, coalesce(main, {I.sql_text('html')}) AS text FROM p LEFT JOIN gated USING (crawl_seq))
SELECT crawl_seq, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_words FROM chosen""")
def english_main_texts(spark, sf_dir):
    """Main text behind the language gate."""
    return P.main_text(I.pages(spark, sf_dir), target_language="en").select(
        "crawl_seq", T.word_count("text_content").cast("long").alias("n_words"))


@query(f"""{_MAIN}, often AS (SELECT site_id, text FROM blocks GROUP BY 1, 2 HAVING count(DISTINCT url) >= 2)
SELECT site_id, url, text FROM blocks ANTI JOIN often USING (site_id, text)""")
def blocks_without_boilerplate(spark, sf_dir):
    return P.drop_site_boilerplate(P.page_blocks(I.pages(spark, sf_dir)), min_pages=2).select("site_id", "url", "text")


@query("""SELECT site, text FROM (SELECT source AS site, doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS text FROM documents)
GROUP BY site, text HAVING count(DISTINCT doc_id) < 3""")
def rare_document_lines(spark, sf_dir):
    lines = I.docs(spark, sf_dir).select("site_id", "url", F.explode(F.split("text_content", "\n")).alias("text"))
    return P.drop_site_boilerplate(lines).select(F.col("site_id").alias("site"), "text").distinct()


@query(f"""WITH {I.TEXTS} SELECT crawl_seq, CASE WHEN text_content = '' THEN 0 ELSE len(string_split(text_content, ' ')) END AS n_words FROM t""")
def word_counts(spark, sf_dir):
    return I.pages(spark, sf_dir).select("crawl_seq", T.word_count(H.visible_text("html")).cast("long").alias("n_words"))


@query(f"""WITH {I.DOC_LINES}, n AS (SELECT crawl_seq, count(*) FILTER (WHERE i % 4 = 0) AS n_h2, count(*) FILTER (WHERE i % 4 = 2) AS n_h3,
  count(*) FILTER (WHERE i % 4 = 3) AS n_h4, count(*) FILTER (WHERE i % 4 = 1) AS n_internal, count(*) FILTER (WHERE i % 4 = 3) AS n_external,
  count(*) FILTER (WHERE i % 4 = 2) AS n_images FROM l GROUP BY 1)
SELECT site_id, crawl_seq, url, 200 AS status_code, lines[1] AS title, lines[1] AS meta_description, lines[1] || 'doc' AS h1,
  n_h2, n_h3, n_h4, n_internal, n_external, n_images FROM h JOIN n USING (crawl_seq)""")
def parsed_pages(spark, sf_dir):
    p = P.parse_pages(I.doc_html(spark, sf_dir))

    def n(column):
        return F.size(column).cast("long")

    return p.select(
        "site_id", "crawl_seq", "url", "status_code", "title", "meta_description", "h1",
        *[n(F.element_at("headings", F.lit(level))).alias(f"n_{level}") for level in P.LEVELS],
        n("internal_links").alias("n_internal"), n("external_links").alias("n_external"), n("images").alias("n_images"))


@query(f"""{_MAIN}, main AS (SELECT crawl_seq, string_agg(text, chr(10) ORDER BY k) AS main FROM blocks GROUP BY 1),
whole AS (SELECT p.crawl_seq, url, replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&') AS title, coalesce(main, {I.sql_text('html')}) AS text_content,
  len(regexp_extract_all(html, '<a href="/')) AS n_internal FROM p LEFT JOIN main USING (crawl_seq))
SELECT *, len(list_filter(regexp_split_to_array(text_content, '\\s+'), lambda w: w <> ''))::INTEGER AS word_count FROM whole""")
def parsed_page_texts(spark, sf_dir):
    """Article text and word count of the full page record over the stored pages."""
    return P.parse_pages(I.pages(spark, sf_dir)).select(
        "crawl_seq", "url", "title", "text_content", F.size("internal_links").cast("long").alias("n_internal"), "word_count")


@query(f"""WITH {I.PAGES} SELECT site_id, crawl_seq, row_number() OVER (PARTITION BY site_id ORDER BY crawl_seq) AS page_rank
FROM p QUALIFY page_rank <= 5""")
def first_site_pages(spark, sf_dir):
    p = I.pages(spark, sf_dir).select("site_id", "crawl_seq")
    return first_pages(p, 5, name="page_rank").withColumn("page_rank", F.col("page_rank").cast("long"))


@query(f"{_LINK_ROWS} SELECT url, target FROM links WHERE pos < 2")
def first_page_links(spark, sf_dir):
    return first_links(P.page_links(I.doc_html(spark, sf_dir)), 2).select("url", "target")


@query("""SELECT source AS site_id, count(*) AS pages_crawled, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::BIGINT AS total_words
FROM documents GROUP BY source""")
def crawl_reports(spark, sf_dir):
    return crawl_report(I.docs(spark, sf_dir).select("site_id", T.word_count("text_content").alias("word_count")))
