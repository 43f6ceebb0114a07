"""Robots rules, sitemaps and link-graph reach."""

from pyspark.sql import functions as F

from ..functions.urls import site_of
from ..operators import frontier as C
from ..operators.parse import page_links as parse_links
from ..operators.ranking import cap_pages, cap_sitemap
from ..operators.robots_filter import match_rules, robots_allowed
from ..sources import parse_robots, parse_sitemap, robots_arrays, robots_sitemaps, sitemap_urls
from . import inputs as I
from .registry import query


@query(f"WITH {I.ROBOTS} SELECT host, seq, allow, prefix FROM rules")
def robots_rules(spark, sf_dir):
    return parse_robots(I.robots(spark, sf_dir))


@query(f"WITH {I.ROBOTS} SELECT host, 1 AS seq, false AS allow, '/' AS prefix FROM per_host WHERE host NOT LIKE 'm.%'")
def robots_rules_for_named_agent(spark, sf_dir):
    return parse_robots(I.robots(spark, sf_dir), agent="BadBot/2.0")


@query(f"WITH {I.ROBOTS} SELECT host, 'https://' || host || '/sm-' || last || '.xml' AS sitemap_url FROM per_host WHERE host NOT LIKE 'm.%'")
def robots_sitemap_lines(spark, sf_dir):
    return robots_sitemaps(I.robots(spark, sf_dir))


@query(f"WITH {I.SITEMAPS} SELECT sitemap_url, url FROM sm")
def sitemap_entries(spark, sf_dir):
    return parse_sitemap(I.sitemaps(spark, sf_dir))


@query(f"""WITH {I.SITEMAPS} SELECT DISTINCT sm.site_id, sm.url FROM sm JOIN per_host ON host = sm.site_id
WHERE sitemap_url LIKE '%/sitemap.xml' OR (host NOT LIKE 'm.%' AND sitemap_url = 'https://' || host || '/sm-' || last || '.xml')""")
def site_sitemap_urls(spark, sf_dir):
    return sitemap_urls(robots_sitemaps(I.robots(spark, sf_dir)), I.sitemaps(spark, sf_dir))


_MATCH = f"""WITH {I.ROBOTS}, u AS (SELECT site_id, url, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) = '' THEN '/'
  ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) END AS pq FROM p),
hit AS (SELECT url, seq, allow FROM u JOIN rules ON host = site_id WHERE starts_with(pq, prefix) QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1),
m AS (SELECT site_id, url, coalesce(allow, true) AS allow FROM u LEFT JOIN hit USING (url))"""


@query(f"{_MATCH} SELECT site_id, url, allow FROM m")
def rule_matches(spark, sf_dir):
    urls = I.pages(spark, sf_dir).select("site_id", "url")
    return match_rules(urls, parse_robots(I.robots(spark, sf_dir)))


@query(f"{_MATCH} SELECT site_id, url FROM m WHERE allow")
def robots_allowed_urls(spark, sf_dir):
    urls = I.pages(spark, sf_dir).select("site_id", "url")
    return robots_allowed(urls, robots_arrays(I.robots(spark, sf_dir)))


def _start(spark, sf_dir):
    p = I.pages(spark, sf_dir)
    return p.groupBy("site_id").agg(F.min_by("url", "crawl_seq").alias("url"))


_START = "start AS (SELECT site_id, min_by(url, crawl_seq) AS url FROM p GROUP BY 1)"


@query(f"""WITH {I.SITEMAPS}, {_START} SELECT site_id, url FROM start UNION SELECT * FROM (SELECT DISTINCT site_id, url FROM sm
QUALIFY dense_rank() OVER (PARTITION BY site_id ORDER BY url) <= 3)""")
def seed_urls(spark, sf_dir):
    entries = parse_sitemap(I.sitemaps(spark, sf_dir)).select(site_of("sitemap_url").alias("site_id"), "url")
    return C.seed_urls(_start(spark, sf_dir), entries, max_sitemap=3)


@query(f"""WITH {I.SITEMAPS} SELECT DISTINCT site_id, url FROM sm QUALIFY dense_rank() OVER (PARTITION BY site_id ORDER BY url) <= 4""")
def capped_sitemaps(spark, sf_dir):
    entries = parse_sitemap(I.sitemaps(spark, sf_dir)).select(site_of("sitemap_url").alias("site_id"), "url").distinct()
    return cap_sitemap(entries, 4)


_VISITED = "v AS (SELECT site_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS url FROM p WHERE url LIKE 'https%')"
_LINKED = "a AS (SELECT DISTINCT site_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS url FROM p)"


@query(f"WITH {I.PAGES}, {_VISITED}, {_LINKED} SELECT site_id, url FROM a ANTI JOIN v USING (site_id, url)")
def unvisited_links(spark, sf_dir):
    """Links of all pages without those already linked from https pages."""
    links = parse_links(I.pages(spark, sf_dir)).withColumn("secure", F.col("url").startswith("https"))
    visited = links.filter("secure").select("site_id", F.col("target").alias("url")).distinct()
    return C.minus_visited(links.select("site_id", F.col("target").alias("url")).distinct(), visited)


@query(f"WITH {I.PAGES}, {_LINKED}, {_START} SELECT site_id, url FROM a UNION SELECT site_id, url FROM p EXCEPT SELECT site_id, url FROM start")
def frontier_difference(spark, sf_dir):
    p = I.pages(spark, sf_dir)
    links = parse_links(p).select("site_id", F.col("target").alias("url"))
    return C.frontier_minus(links.unionByName(p.select("site_id", "url")).distinct(), _start(spark, sf_dir))


_REACH = f"""WITH RECURSIVE {I.PAGES}, {I.EDGES}, {_START}, reach AS (SELECT site_id, url, 0 AS depth FROM start
  UNION SELECT e.site_id, e.dst, depth + 1 FROM reach r JOIN edges e ON e.site_id = r.site_id AND e.src = r.url)"""


@query(f"{_REACH} SELECT site_id, url, min(depth) AS depth FROM reach GROUP BY 1, 2")
def crawl_frontier(spark, sf_dir):
    return C.crawl_frontier(I.edges(spark, sf_dir), _start(spark, sf_dir))


_ALLOWED_REACH = f"""WITH RECURSIVE {I.ROBOTS}, {I.EDGES}, {_START},
u AS (SELECT site_id, url, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) END AS pq FROM p),
hit AS (SELECT url, allow FROM u JOIN rules ON host = site_id WHERE starts_with(pq, prefix) QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1),
ok AS (SELECT site_id, url FROM u LEFT JOIN hit USING (url) WHERE coalesce(allow, true)),
reach AS (SELECT site_id, url, 0 AS depth FROM start SEMI JOIN ok USING (site_id, url)
  UNION SELECT e.site_id, e.dst, depth + 1 FROM reach r JOIN edges e ON e.site_id = r.site_id AND e.src = r.url JOIN ok ON ok.site_id = e.site_id AND ok.url = e.dst)"""


@query(f"""{_ALLOWED_REACH}, one AS (SELECT site_id, url, min(depth) AS depth FROM reach GROUP BY 1, 2)
SELECT site_id, url, depth FROM one QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY depth, url) <= 10""")
def capped_allowed_frontier(spark, sf_dir):
    """Reach under robots rules with a page cap per site."""
    return C.crawl_frontier(I.edges(spark, sf_dir), _start(spark, sf_dir), robots_arrays(I.robots(spark, sf_dir)), max_pages=10)


@query(f"""{_REACH}, one AS (SELECT site_id, url, min(depth) AS depth FROM reach GROUP BY 1, 2) SELECT * FROM one
QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY depth, url) <= 4""")
def capped_pages(spark, sf_dir):
    return cap_pages(C.crawl_frontier(I.edges(spark, sf_dir), _start(spark, sf_dir)), 4)


@query(f"""{_ALLOWED_REACH}, one AS (SELECT DISTINCT site_id, url FROM reach)
SELECT site_id, count(*) AS pages_stored, count(one.url) AS pages_reached, count(one.url) AS stored_reached
FROM p LEFT JOIN one USING (site_id, url) GROUP BY site_id""")
def site_coverage(spark, sf_dir):
    reached = C.crawl_frontier(I.edges(spark, sf_dir), _start(spark, sf_dir), robots_arrays(I.robots(spark, sf_dir)))
    return C.coverage(reached, I.pages(spark, sf_dir))
