"""Robots, sitemaps, frontier."""
import random
import urllib.robotparser

import pytest
from pyspark.sql import functions as F

from sitelode.operators import frontier as C
from sitelode.operators.robots_filter import match_rules, robots_allowed, robots_index
from sitelode.session import durable_buckets
from sitelode.sources import parse_robots, parse_sitemap, robots_arrays, robots_sitemaps, sitemap_urls

BODIES = {
    "first-match.com": "User-agent: *\nDisallow: /a\nAllow: /a/b\n",
    "allow-first.com": "User-agent: *\nAllow: /a/b\nDisallow: /a\n",
    "no-wildcards.com": "User-agent: *\nDisallow: /*.pdf$\n",
    "two-groups.com": "User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /z\n",
    "foreign.com": "User-agent: bot\nDisallow: /\n",
    "empty-disallow.com": "User-agent: *\nDisallow: /z\nDisallow:\nDisallow: /a\n",
    "blank-in-group.com": "User-agent: *\n\nDisallow: /\n",
    "shared.com": "User-agent: bot\nUser-agent: *\nDisallow: /a # why\n\nDisallow: /z\n",
    "escaped.com": "User-agent: *\nDisallow: /a%20b\nDisallow: /x+y\nDisallow: /%7Ez\n",
    "star-path.com": "User-agent: *\nDisallow: *\n",
    "query.com": "USER-AGENT:*\r\ndisallow : /a?q=1\r\n",
    "delay.com": "User-agent: *\nCrawl-delay: 3\nDisallow: /a\nSitemap: https://delay.com/s.xml\nno colon here\n",
    "adjacent.com": "User-agent: bot\nDisallow: /\nUser-agent: *\nDisallow: /z\n",
}
PATHS = ["", "/", "/a", "/a/b", "/a/b/c", "/x.pdf", "/z", "/a b", "/a%20b", "/x+y", "/~z", "/%7ez", "/a?q=1", "/a?q=12", "/ab"]


@pytest.mark.parametrize("agent", ["*", "Bot/1.0"])
def test_rules_match_standard_library(spark, agent):
    robots = spark.createDataFrame([(h, 200, b) for h, b in BODIES.items()], "host string, status int, body string")
    want = []
    for host, body in BODIES.items():
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(body.splitlines())
        want += [(host, f"https://{host}{p}", parser.can_fetch(agent, f"https://{host}{p}")) for p in PATHS]
    urls = spark.createDataFrame([(h, u) for h, u, _ in want], "site_id string, url string")
    for rules in (robots_arrays(robots, agent), parse_robots(robots, agent)):
        got = {(r["url"]): r["allow"] for r in match_rules(urls, rules).collect()}
        assert {u: a for _, u, a in want} == got


def test_failed_robots_allow_all(frame):
    rules = parse_robots(frame("host string, status int, body string", ("h.com", 404, "User-agent: *\nDisallow: /")))
    urls = frame("site_id string, url string", ("h.com", "https://h.com/a"), ("o.com", "https://o.com/a"))
    assert robots_allowed(urls, rules).count() == 2


def test_respect_robots_off(frame):
    rules = parse_robots(frame("host string, status int, body string", ("h.com", 200, "User-agent: *\nDisallow: /")))
    urls = frame("site_id string, url string", ("h.com", "https://h.com/a"))
    assert robots_allowed(urls, rules).count() == 0
    assert robots_allowed(urls, rules, respect_robots=False).count() == 1


def test_sitemaps(frame, values):
    robots = frame("host string, status int, body string", ("h.com", 200, BODIES["delay.com"].replace("delay.com", "h.com")))
    maps = frame("sitemap_url string, body string",
                 ("https://h.com/s.xml", '<urlset xmlns="x"><url><loc> https://h.com/a?x=1&amp;y=2 </loc></url></urlset>'),
                 ("https://h.com/sitemap.xml", "<urlset><loc><![CDATA[https://h.com/b]]></loc><loc>https://h.com/a?x=1&amp;y=2</loc>"),
                 ("https://h.com/unlisted.xml", "<loc>https://h.com/no</loc>"))
    assert parse_sitemap(maps).count() == 4
    assert values(sitemap_urls(robots_sitemaps(robots), maps)) == [("h.com", "https://h.com/a?x=1&y=2"), ("h.com", "https://h.com/b")]


def graph(frame):
    pairs = [("a", "b", 0), ("a", "c", 1), ("b", "a", 0), ("b", "d", 1), ("c", "d", 0), ("d", "e", 0), ("a", "z", 10)]
    return frame("site_id string, src string, dst string, pos int", *[("s", f"https://s/{x}", f"https://s/{y}", p) for x, y, p in pairs])


def reach(df):
    return sorted((r["url"][-1], r["depth"]) for r in df.collect())


def test_frontier_depths_caps_and_rules(frame):
    seeds = frame("site_id string, url string", ("s", "https://s/a"))
    edges = graph(frame)
    assert reach(C.crawl_frontier(edges, seeds)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert reach(C.crawl_frontier(edges, seeds, max_pages=2)) == [("a", 0), ("b", 1)]
    assert reach(C.crawl_frontier(edges, seeds, max_pages=4)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert reach(C.crawl_frontier(edges, seeds, max_depth=1)) == [("a", 0), ("b", 1), ("c", 1)]
    rules = parse_robots(frame("host string, status int, body string", ("s", 200, "User-agent: *\nDisallow: /d")))
    assert reach(C.crawl_frontier(edges, seeds, rules)) == [("a", 0), ("b", 1), ("c", 1)]
    stored = frame("site_id string, url string", *[("s", f"https://s/{x}") for x in "abd"])
    assert reach(C.crawl_frontier(edges, seeds, stored=stored)) == [("a", 0), ("b", 1), ("d", 2)]


def test_frontier_invariants(frame):
    seeds = frame("site_id string, url string", ("s", "https://s/a"), ("s", "https://s/d"))
    got = C.crawl_frontier(graph(frame), seeds)
    assert got.groupBy("site_id", "url").count().filter("count > 1").isEmpty()
    pages = frame("site_id string, url string", ("s", "https://s/a"), ("s", "https://s/q"))
    row = C.coverage(got, pages).first()
    assert (row["pages_stored"], row["pages_reached"], row["stored_reached"]) == (2, 5, 1)


def test_seed_and_set_operators(frame, values):
    start = frame("site_id string, url string", ("s", "u1"))
    listed = frame("site_id string, url string", ("s", "u2"), ("s", "u1"), ("s", "u3"))
    assert values(C.seed_urls(start, listed, 2)) == [("s", "u1"), ("s", "u2")]
    assert values(C.minus_visited(listed, start)) == [("s", "u2"), ("s", "u3")]
    assert C.frontier_minus(listed, listed).isEmpty()
    assert start.filter(F.col("url") == "u1").count() == 1


def test_many_rules_on_one_host(spark):
    """50,000 prefixes, repeated ones among them: the first rule in file order still decides, found in the row of the host."""
    rules = spark.range(50_000).select(F.lit("h.com").alias("host"), F.col("id").alias("seq"), (F.col("id") % 3 == 0).alias("allow"),
                                       F.concat(F.lit("/"), (F.col("id") * 7919 % 40_000).cast("string")).alias("prefix"))
    listed = [tuple(r) for r in rules.orderBy("seq").select("prefix", "allow").collect()]
    paths = [f"/{n}" for n in range(0, 60_000, 997)] + ["/", "/x", "/12/a?b", "/399999999"]
    want = {f"https://h.com{p}": next((a for prefix, a in listed if p.startswith(prefix)), True) for p in paths}
    urls = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r["url"]: r["allow"] for r in match_rules(urls, rules).collect()} == want
    index = robots_index(rules).first()
    assert len(index["slots"]) == 40_000 and max(map(len, index["slots"])) < 12 and sorted(index["lengths"]) == [2, 3, 4, 5, 6]


def test_rules_without_rows_or_prefix(frame):
    schema = "host string, seq int, allow boolean, prefix string"
    urls = frame("url string", ("https://h.com/a",), (None,), ("no url",))
    for rules in (frame(schema), frame(schema, ("h.com", 1, False, None), (None, 1, False, "/"))):
        assert [r["allow"] for r in match_rules(urls, rules).collect()] == [True] * 3


def test_long_chain_merges_its_visited_tables(spark, monkeypatch):
    """A chain with links back and a random graph against a queue, with so few runs that merges happen."""
    monkeypatch.setattr(C, "RUNS", 2)
    rng = random.Random(5)
    pairs = {("c", str(n), str(m)) for n in range(9) for m in (n + 1, n // 2)} | {
        ("r", str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(70)}
    seeds = {("c", "0"), ("r", "0")}
    want, now, depth = {}, seeds, 0
    while now:
        want.update({k: depth for k in now})
        now = {(s, d) for s, a, d in pairs if (s, a) in now} - set(want)
        depth += 1
    edges = spark.createDataFrame([(*p, 0) for p in pairs], "site_id string, src string, dst string, pos int")
    got = C.crawl_frontier(edges, spark.createDataFrame(sorted(seeds), "site_id string, url string"))
    assert sorted(map(tuple, got.collect())) == sorted((s, u, d) for (s, u), d in want.items())
    assert len(want) > 20 and depth > 8


def test_levels_join_visited_tables_where_they_lie(spark):
    """Above the size of a broadcast, neither the links nor the visited URLs are exchanged."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select(F.lit("s").alias("site_id"), F.col("id").cast("string").alias("url"))
        visited = durable_buckets(rows, C.KEY, 8)
        links = durable_buckets(rows.withColumn("dst", F.lit("x")), C.KEY, 8)
        joined = visited.join(links, C.KEY)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        new = spark.range(2000).select(F.concat(F.lit("s"), (F.col("id") % 1).cast("string")).alias("site_id"), F.col("id").cast("string").alias("url"))
        plan = C.minus_visited(C.minus_visited(new.distinct(), visited), visited)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        assert joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
