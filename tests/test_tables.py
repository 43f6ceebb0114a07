"""Rules, keywords, exports, jobs and streams."""
import datetime as dt
import random
import json

import pytest
from pyspark.sql import functions as F

from sitelode.catalog import QUERIES
from sitelode.config import RunConfig
from sitelode.operators import facets as X, keywords as K, parse as P, reports as A
from sitelode.operators.ranking import rank_rows
from sitelode.operators.quality import rule_counts, rules_for, validate
from sitelode.operators.similar import similar_sets
from sitelode.plans import export, runs
from sitelode.plans.export import export_jobs, export_tables
from sitelode.schema import BRIEFS, DRAFTS, KEYWORDS
from sitelode.operators.robots_filter import match_rules
from sitelode.session import INPUT_PARTITIONS, WRITTEN, drop_tables, durable, shared_folder, spread
from sitelode.sinks import render as R, writers as W
from sitelode.sources import read_pages, read_report
from sitelode.streaming import intake, jobs as J

TS = dt.datetime(2024, 1, 2, 3, 4, 5)


def brief(**change):
    base = dict(
        site_id="s", idx=1, topic="Tea & you", primary_keyword="tea", secondary_keywords=["a", "b", "c"], content_type="blog",
        target_url="/tea", h1="Tea", page_title="t" * 60, meta_description="m" * 120, key_takeaways=["1", "2", "3"], definitions=[],
        key_stats=[], decision_tips=["try"], internal_links=[("https://s/1", "one", 0.25)] * 3, audience="all", tone="friendly",
        pov="third_person", word_count_min=800, word_count_max=1200, sources=[], cta="Buy", restrictions=[], requirements=[],
        headings_outline=[("h2", "What"), ("h5", "skip"), ("h3", "Why")], faqs=[("q?", "w " * 30)] * 4)
    return {**base, **change}


@pytest.mark.parametrize("change,rules", [
    ({}, set()), ({"page_title": "t" * 61}, {"length_0_60"}), ({"meta_description": "m" * 119}, {"length_120_160"}),
    ({"meta_description": "m" * 160}, set()), ({"meta_description": "m" * 161}, {"length_120_160"}),
    ({"faqs": [("q", "w " * 30)] * 3}, {"size_4_4"}), ({"faqs": [("q", "w " * 30)] * 5}, {"size_4_4"}),
    ({"faqs": [("q", "w " * 29)] * 4}, {"answer_words_min_30"}), ({"secondary_keywords": ["a"] * 7}, {"size_3_6"}),
    ({"internal_links": [("nope", "x", 2.0)] * 3}, {"link_url", "relevance_0_1"}), ({"tone": "loud"}, {"allowed"}),
    ({"cta": None, "faqs": None}, {"required"}), ({"internal_links": [("https://s/1", "x", None)] * 3}, {"relevance_0_1"}),
    ({"key_takeaways": ["1"] * 6}, {"size_3_5"}), ({"internal_links": []}, {"size_3_up"}),
])
def test_brief_rules(spark, change, rules):
    df = spark.createDataFrame([brief(**change)], BRIEFS)
    assert {r["rule"] for r in validate(df, rules_for("brief"), "topic").collect()} == rules


@pytest.mark.parametrize("week,n,bad", [(0, 3, 1), (1, 3, 0), (52, 6, 0), (53, 6, 1), (5, 2, 1), (5, 7, 1)])
def test_calendar_rules(frame, week, n, bad):
    df = frame("topic string, week int, secondary_keywords array<string>, estimated_effort_hours double, priority string, content_type string, "
               "primary_keyword string, cluster_id string", ("t", week, ["k"] * n, 1.0, "high", "blog", "p", "c"))
    assert validate(df, rules_for("calendar"), "topic").count() == bad


def test_empty_records_break_every_required_field(spark):
    schema = spark.createDataFrame([], BRIEFS).schema
    empty = spark.createDataFrame([tuple("s" if f == "site_id" else None for f in schema.fieldNames())], schema)
    found = validate(empty, rules_for("brief"), "site_id").collect()
    assert len(found) == 16 and {r["rule"] for r in found} == {"required"}


def test_config_defaults_pass(spark):
    assert validate(RunConfig().to_frame(spark), rules_for("config"), "config_id").isEmpty()
    bad = RunConfig(crawl_delay=0.4, min_cluster_size=1, export_format="pdf").to_frame(spark)
    assert validate(bad, rules_for("config"), "config_id").count() == 3


def test_optional_and_required(frame):
    df = frame(KEYWORDS, ("s", "t", None, 0.5, None, "commercial", [], False, None, 0.0, None, False, 50.0))
    assert [(r["field"], r["rule"]) for r in validate(df, rules_for("keyword"), "term").collect()] == [("volume", "required")]
    counts = {(r["field"], r["rule"]): (r["passed"], r["failed"]) for r in rule_counts(df, rules_for("keyword")).collect()}
    assert counts[("volume", "required")] == (0, 1) and counts[("cpc", "min_0")] == (1, 0)


def test_clusters(frame):
    terms = ["red tea pot", "red tea cup", "blue tea cup", "green hat", "old green hat", "lone", "blue cup", "blue door", "steel door"]
    df = frame("site_id string, term string, cluster_id string", *[(s, t, None) for s in ("s", "r") for t in terms])
    got = {(r["site_id"], r["term"]): r["cluster_id"] for r in K.cluster_keywords(df, min_size=2).collect()}
    for site in ("s", "r"):
        assert {got[(site, t)] for t in [*terms[:3], "blue cup"]} == {"blue cup"}
        assert got[(site, "steel door")] is None
        assert {got[(site, t)] for t in terms[3:5]} == {"green hat"}
        assert got[(site, "lone")] is None
    loose = {r["term"]: r["cluster_id"] for r in K.cluster_keywords(df, threshold=0.3).filter("site_id = 's'").collect()}
    assert loose["steel door"] == loose["blue cup"] == loose["red tea pot"] and loose["green hat"] is None


def test_marks_are_exact(frame):
    """Terms end in one group just when a chain of pairs is similar enough."""
    words = ["a", "b", "c", "d", "e"]
    sets = [[w for i, w in enumerate(words) if m >> i & 1] for m in range(1, 32)]
    for t in (0.3, 0.5, 0.75, 1.0):
        parent = list(range(31))

        def top(i):
            return i if parent[i] == i else top(parent[i])

        for i in range(31):
            for j in range(i):
                a, b = set(sets[i]), set(sets[j])
                if len(a & b) / len(a | b) >= t - 1e-9:
                    parent[max(top(i), top(j))] = min(top(i), top(j))
        df = frame("site_id string, term string", *[("s", " ".join(x)) for x in sets])
        got = {r["term"]: r["cluster_id"] for r in K.cluster_keywords(df, t, 1).collect()}
        groups = {}
        for i in range(31):
            groups.setdefault(top(i), []).append(" ".join(sets[i]))
        assert {frozenset(g) for g in groups.values()} == {
            frozenset(k for k, v in got.items() if v == c) for c in set(got.values())}


@pytest.mark.parametrize("t,full", [(0.5, 256), (0.5, 4), (0.7, 3), (0.25, 6)])
def test_clusters_of_long_terms(frame, t, full, monkeypatch):
    """Terms of 1 to 60 words against all pairs, with words that most terms share and families of near-equal terms."""
    rng = random.Random(int(t * 100) + full)
    rare, hot = [f"w{i}" for i in range(120)], [f"h{i}" for i in range(8)]
    terms = {" ".join(rng.sample(hot, rng.randint(0, 4)) + rng.sample(rare, rng.randint(1, rng.choice([2, 5, 12, 56])))) for _ in range(110)}
    for size in (3, 8, 20, 60):
        base = rng.sample(rare, size)
        terms |= {" ".join(rng.sample(base, size - rng.randint(0, 2)) + rng.sample(hot, rng.randint(0, 2))) for _ in range(14)}
    terms = sorted(terms | {"", " ", "W1", "w1 w1"})
    words = [frozenset(x.lower().split()) for x in terms]
    group = list(range(len(terms)))
    top = lambda i: i if group[i] == i else top(group[i])
    for i in range(len(terms)):
        for j in range(i):
            a, b = words[i], words[j]
            if a == b or len(a & b) >= t * len(a | b) - 1e-9 and a & b:
                group[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, term in enumerate(terms):
        least[top(i)] = min(least.get(top(i), term), term)
    monkeypatch.setattr(K, "similar_sets", lambda sets, threshold: similar_sets(sets, threshold, full))
    df = frame("site_id string, term string", *[("s", x) for x in terms], ("r", terms[5]))
    got = {(r["site_id"], r["term"]): r["cluster_id"] for r in K.cluster_keywords(df, t, 1).collect()}
    assert got.pop(("r", terms[5])) == terms[5]
    assert got == {("s", x): least[top(i)] for i, x in enumerate(terms)}
    assert 1 < len(set(got.values())) < len(terms)


def test_components_match_brute_force(spark):
    edges = [(i, f"g{(i * 37) % 61}") for i in range(150)] + [(i, f"h{i // 2}") for i in range(0, 150, 5)] + [(i, "hub") for i in range(60, 110)]
    label = {i: i for i in range(150)}
    for _ in range(150):
        best = {}
        for n, s in edges:
            best[s] = min(best.get(s, 999), label[n])
        label = {n: min([label[n]] + [best[s] for m, s in edges if m == n]) for n in label}
    got = K.connected_labels(spark.createDataFrame(edges, "node long, sig string"))
    assert {r["node"]: r["label"] for r in got.collect()} == label


def test_gaps_and_primary(frame):
    ranks = frame("site_id string, keyword string, domain string, position int, own boolean",
                  *[(site, *r) for site in ("s", "t") for r in (("a", "x", 2, False), ("b", "x", 3, False), ("c", "x", 4, False), ("c", "y", 2, False))],
                  ("s", "a", "me", 5, True), ("s", "b", "me", 1, True), ("t", "a", "us", 1, True))
    volumes = frame("site_id string, keyword string, volume int", *[(site, k, v) for site in ("s", "t") for k, v in (("a", 100), ("b", 100), ("c", 10))])
    rows = K.gap_analysis(ranks, volumes).collect()
    got = {(r["site_id"], r["keyword"]): (r["opportunity_type"], round(r["gap_score"], 4)) for r in rows}
    assert got == {("s", "a"): ("underperforming", 30.0), ("s", "c"): ("missing", 5.0),
                   ("t", "b"): ("missing", 33.3333), ("t", "c"): ("missing", 5.0)}
    assert {r["keyword"]: r["competitors_ranking"] for r in rows}["c"] == {"x": 4, "y": 2}
    k = frame("site_id string, cluster_id string, term string, volume int", ("s", "c", "b", 5), ("s", "c", "a", 5), ("s", None, "z", 9))
    assert [r["term"] for r in K.mark_primary(k).filter("is_primary").collect()] == ["a"]


def test_draft_checks(frame):
    texts = ["The color is red. See https://s/a.", "Colour! https://s/no", "[x](/about) and [y](/a), colour", "Behaviors vary, see https://other/z",
             "We are organizing [m](mailto:x@s)"]
    drafts = frame("site_id string, idx int, content string", *[("s", i, t) for i, t in enumerate(texts)])
    pages = frame("site_id string, url string", ("s", "https://s/a"))
    got = {r["idx"]: (r["uk_english_verified"], r["internal_links_validated"]) for r in K.draft_qa(drafts, pages).collect()}
    assert got == {0: (False, True), 1: (True, False), 2: (True, False), 3: (False, True), 4: (False, True)}


def test_terms_of_any_length_and_case(frame):
    pages = frame("site_id string, text_content string", ("s", "We offer Search Engine Optimisation Services, and C++ hosting."))
    terms = ["search engine optimisation services", "SEO Services", "C++ hosting", "Search engine", "engine services"]
    k = frame("site_id string, term string", *[("s", t) for t in terms])
    got = {r["term"]: r["verified_against_site"] for r in K.verify_keywords(k, pages).collect()}
    assert got == dict(zip(terms, [True, False, True, True, False]))
    assert {r["term"] for r in K.site_evidence(k, pages).collect()} == {t for t in terms if got[t]}


def test_sites_with_equal_cluster_ids(frame):
    k = frame("site_id string, cluster_id string, term string", *[(s, "c", f"t{i}") for s, n in (("a", 2), ("b", 3)) for i in range(n)])
    assert {(r["site_id"], r["members_count"]) for r in A.cluster_sizes(k).collect()} == {("a", 2), ("b", 3)}
    clusters = frame("site_id string, id string, label string, pillar string, total_volume long", ("a", "c", "l", "p", 1), ("b", "c", "l", "p", 1))
    rows = {r["site_id"]: json.loads(r["content"])["members_count"] for r in R.clusters_json(clusters, k).collect()}
    assert rows == {"a": 2, "b": 3}


def test_default_mix_can_be_filled(frame):
    rows = [("s", f"c{i:03d}", f"c{i:03d} t{j}", 100 - j, ("informational", "commercial", "transactional", "navigational")[i % 4])
            for i in range(80) for j in range(4)]
    k = frame("site_id string, cluster_id string, term string, volume int, intent string", *rows)
    c = RunConfig()
    plan = K.content_calendar(K.cluster_rollup(k), k, c.content_mix, c.calendar_weeks)
    assert plan.groupBy("content_type").count().collect() and {r["content_type"]: r["count"] for r in plan.groupBy("content_type").count().collect()} == c.content_mix
    items = K.calendar_items(K.cluster_rollup(k), k)
    assert [(r["content_type"], r["items"]) for r in K.unquoted_types(items, {"blog": 1, "service": 1, "product": 1}).collect()] == [("landing", 20)]


def test_brief_markdown(spark):
    row = R.render_briefs(spark.createDataFrame([brief()], BRIEFS)).first()
    text = row["content"]
    assert row["filename"] == "001-tea-you-brief.md"
    assert text.startswith("# Tea & you - Content Brief V2.0\n\n---\n\n## Web Page Structure\n\n**Target URL:** /tea\n")
    assert "| https://s/1 | one | 0.2 |" in text and "### Decision Tips\n\n- try\n" in text
    assert "### Definitions" not in text and "### Requirements" not in text and "skip" not in text
    assert "## Suggested Headings\n\n## What\n### Why\n\n## Frequently Asked Questions" in text
    assert text.endswith("## Call to Action\n\nBuy\n")


def test_draft_header(spark):
    draft = ("s", 2, "b 1", "Body", 1, 71.236, True, True, False, False, [], TS)
    row = R.render_drafts(spark.createDataFrame([draft], DRAFTS)).first()
    assert row["filename"] == "002-b-1-draft.md"
    assert row["content"] == ("---\nbrief_id: b 1\nword_count: 1\nreadability_score: 71.24\nuk_english_verified: True\n"
                              "facts_verified: False\ncreated_at: 2024-01-02T03:04:05\n---\n\nBody\n")


def test_calendar_index_pairs_by_position(frame):
    calendar = frame("site_id string, idx long, week int, topic string, content_type string, primary_keyword string, secondary_keywords array<string>, "
                     "cluster_id string, priority string", ("s", 1, 1, "x", "blog", "k", ["a", "b"], "c", "high"), ("s", 2, 2, "y", "blog", "k", [], "c", "low"))
    briefs = frame("site_id string, idx int, filename string", ("s", 1, "1.md"))
    drafts = frame("site_id string, idx int, filename string, word_count int", ("s", 2, "2.md", 9))
    rows = {r["topic"]: r for r in R.calendar_index(calendar, briefs, drafts).collect()}
    assert (rows["x"]["brief_link"], rows["x"]["draft_file"], rows["x"]["word_count"]) == ("briefs/1.md", "", 0)
    assert (rows["y"]["brief_file"], rows["y"]["draft_link"], rows["y"]["word_count"]) == ("", "drafts/2.md", 9)
    assert rows["x"]["secondary_keywords"] == "a, b"
    with pytest.raises(ValueError):
        R.calendar_index(calendar.drop("idx"), briefs, drafts)


def test_recorded_run(frame, tmp_path, spark):
    """One page of 26 words gives one page and 26 words; the summary loads back with the report schema."""
    html = "<html><head><title>Example Domain</title></head><body><p>" + "word " * 24 + "</p></body></html>"
    pages = P.parse_pages(frame("site_id string, crawl_seq long, url string, html string", ("example.com", 0, "https://example.com/", html)),
                          article_text=False)
    report = A.crawl_report(pages).first()
    assert (report["pages_crawled"], report["total_words"]) == (1, 26)
    content = json.loads(R.crawl_report_json(pages).first()["content"])
    assert content["pages"] == [{"url": "https://example.com/", "title": "Example Domain", "word_count": 26}]
    facets = frame("site_id string, facet string, value string", *[("example.com", "services", f"a{i:05d}") for i in range(10_500)],
                   *[("example.com", "locations", f"l{i}") for i in range(40)])
    sites = frame("site_id string, name string, homepage string", ("example.com", "Example", "https://example.com/"))
    W.write_rendered(R.run_summary_json(pages, facets, sites, F.lit(TS)), str(tmp_path / "r"))
    back = read_report(spark, str(tmp_path / "r"), multi_line=False).first()
    assert (back["url"], back["pages_crawled"], len(back["business_analysis"]["services"])) == ("https://example.com/", 1, 10)
    assert back["business_analysis"]["services"][0] == "a00000" and len(back["business_analysis"]["locations"]) == 40


def test_export(spark, frame, tmp_path):
    names = frame("site_id string, name string", ("s", "Tea & Co"))
    draft = ("s", 1, "b", "Body", 1, 70.0, True, True, True, True, [], TS)
    tables = {"briefs": spark.createDataFrame([brief()], BRIEFS), "drafts": spark.createDataFrame([draft], DRAFTS)}
    summary = export_jobs(tables, str(tmp_path), names, F.lit(TS))
    assert tuple(summary.first()) == ("s", 1, 1)
    assert len(list(tmp_path.glob("briefs/run=*/client_slug=tea-co/run_ts=20240102_030405"))) == 1
    assert "drafts" not in export_tables(tables, include_drafts=False)


def test_export_keeps_no_second_copy(spark, frame, tmp_path):
    """The rendered tables that outputs share go when a run is written, or failed; JSON lines are compressed and read back whole."""
    names = frame("site_id string, name string", ("s", "Tea & Co"))
    tables = {"briefs": spark.createDataFrame([brief()], BRIEFS)}
    before = set(WRITTEN)
    assert tuple(export_jobs(tables, str(tmp_path), names, F.lit(TS)).first()) == ("s", 1, 0)
    with pytest.raises(FileExistsError):
        export_jobs(tables, str(tmp_path), names, F.lit(TS))
    left = [t for t in WRITTEN if t not in before]
    assert left and not any("filename" in spark.read.parquet(t).columns for t in left)
    assert list(tmp_path.glob("briefs/run=*/client_slug=*/run_ts=*/*.json.gz")) and not list(tmp_path.glob("briefs/run=*/client_slug=*/run_ts=*/*.json"))
    (read,) = runs.read_export(spark, str(tmp_path), "briefs", "site_id string, content string").collect()
    assert read["content"] == R.render_briefs(tables["briefs"]).first()["content"]


def test_export_writes_contents_to_their_files_only(spark, frame, tmp_path, monkeypatch):
    """No table between steps holds rendered contents, and rows that lie by client are not moved to be written."""
    kept, durable = [], export.durable
    monkeypatch.setattr(export, "durable", lambda df, *a: kept.append(df.columns) or durable(df, *a))
    names = frame("site_id string, name string", ("s", "Tea & Co"), ("t", "T"))
    tables = {"briefs": spark.createDataFrame([brief()], BRIEFS), "drafts": spark.createDataFrame([("s", 1, "b", "Body", 1, 70.0, True, True, True, True, [], TS)], DRAFTS)}
    assert tuple(export_jobs(tables, str(tmp_path), names, F.lit(TS)).first()) == ("s", 1, 1)
    assert kept and not any("content" in columns for columns in kept)
    open_files = spark.conf.get(W.OPEN_FILES)
    site = F.when(F.col("id") < 600, "s").when(F.col("id") < 990, "t")
    lie = durable(spark.range(1000).select(site.alias("site_id"), F.col("id").cast("string").alias("content")).repartitionByRange(8, "content").sortWithinPartitions("content"))
    apart = lie.repartition(40, "content")
    ranked = rank_rows(apart, ["site_id"], ["content"], range_rows=100)
    for i, (df, most) in enumerate(((ranked, 40), (apart, 3))):
        W.write_layout(df, path := str(tmp_path / f"layout{i}"), names, F.lit(TS), "json", lying=True)
        back = spark.read.schema("site_id string, content string, client_slug string").json(path)
        assert back.select("site_id", "content").exceptAll(lie).isEmpty() and back.count() == 1000
        assert back.groupBy("client_slug").count().exceptAll(spark.createDataFrame([("tea-co", 600), ("t", 390), ("client", 10)], "c string, n long")).isEmpty()
        assert 3 <= len(set(back.inputFiles())) <= most
        assert W.lies_by_client(R.client_layout(df, names, F.lit(TS))) == (df is ranked)
    assert spark.conf.get(W.OPEN_FILES) == open_files


def test_layout_keeps_other_clients_and_runs(spark, frame, values, tmp_path):
    path = str(tmp_path / "layout")
    table = lambda site, text: frame("site_id string, content string", (site, text), (site, text + "!"))
    names = frame("site_id string, name string", ("a", "A"), ("b", "B"))
    later = F.lit(TS + dt.timedelta(days=1))
    for site, at in (("a", F.lit(TS)), ("b", F.lit(TS)), ("a", later), ("b", later)):
        W.write_layout(table(site, f"{site} first"), path, names, at)
    with pytest.raises(FileExistsError, match="a 20240102_030405"):
        W.write_layout(table("a", "again"), path, names, F.lit(TS))
    W.write_layout(table("a", "a again"), path, names, F.lit(TS), replace=True)
    back = spark.read.schema("content string, client_slug string, run_ts string").parquet(path).filter("content not like '%!'")
    assert values(back, "client_slug", "run_ts", "content") == [
        ("a", "20240102_030405", "a again"), ("a", "20240103_030405", "a first"), ("b", "20240102_030405", "b first"), ("b", "20240103_030405", "b first")]


def test_runs_become_visible_together(spark, frame, values, tmp_path, monkeypatch):
    base, names = str(tmp_path / "store"), frame("site_id string, name string", ("a", "A"), ("b", "B"))
    out = lambda site, text: {k: frame("site_id string, content string", (site, f"{text} {k}")) for k in ("briefs", "drafts")}
    read = lambda name, **how: values(runs.read_export(spark, base, name, "site_id string, content string", **how), "client_slug", "run_ts", "content")
    assert runs.committed(spark, base).isEmpty() and read("briefs") == []
    later = F.lit(TS + dt.timedelta(days=1))
    runs.write_run(out("a", "one"), base, names, F.lit(TS))
    runs.write_run(out("b", "two"), base, names, F.lit(TS))
    good = [("a", "20240102_030405", "one briefs"), ("b", "20240102_030405", "two briefs")]
    assert read("briefs") == good and {r[2] for r in read("drafts")} == {"one drafts", "two drafts"}

    # A run that fails between its outputs leaves what was there, and can be cleared away.
    write = runs.write_layout
    monkeypatch.setattr(runs, "write_layout", lambda df, path, *a, **k: write(df, path, *a, **k) if "/briefs/" in path else 1 / 0)
    for replace, at in ((False, later), (True, F.lit(TS))):
        with pytest.raises(ZeroDivisionError):
            runs.write_run(out("a", "lost"), base, names, at, replace=replace)
    monkeypatch.setattr(runs, "write_layout", write)
    assert read("briefs") == good
    failed = runs.uncommitted(spark, base, "briefs")
    assert len(failed) == 2
    for run in failed:
        runs.drop_run(spark, base, run, ["briefs", "drafts"])
    assert runs.uncommitted(spark, base, "briefs") == [] and read("briefs") == good

    # The same client and time again: an error without replace, else in place of the run before.
    with pytest.raises(FileExistsError, match="a 20240102_030405"):
        runs.write_run(out("a", "three"), base, names, F.lit(TS))
    assert read("briefs") == good
    run = runs.write_run(out("a", "four"), base, names, F.lit(TS), replace=True)
    runs.write_run(out("a", "five"), base, names, later)
    assert [r[2] for r in read("drafts")] == ["four drafts", "five drafts", "two drafts"]
    assert [r[2] for r in read("drafts", runs=runs.latest(spark, base))] == ["five drafts", "two drafts"]
    assert runs.committed(spark, base).select("run").distinct().count() == 4
    with pytest.raises(ValueError, match="committed"):
        runs.drop_run(spark, base, run, ["briefs"])


@pytest.mark.parametrize("fmt", ["csv", "excel", "parquet", "json"])
def test_runs_in_each_format(spark, frame, values, tmp_path, fmt):
    base, names = str(tmp_path / "store"), frame("site_id string, name string", ("a", "A"))
    rows = frame("site_id string, content string", ("a", 'x,"y"\nz'), ("a", "é"))
    runs.write_run({"briefs": rows, "drafts": rows.limit(0)}, base, names, F.lit(TS), fmt)
    assert values(runs.read_export(spark, base, "briefs", "site_id string, content string", fmt), "content") == [('x,"y"\nz',), ("é",)]
    assert values(runs.current(spark, base), "output", "n_rows") == [("briefs", 2)]


def test_read_pages_drops_failures(spark, tmp_path):
    spark.createDataFrame([(1, "u", "<p>"), (2, "v", None), (3, "w", "")], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    assert read_pages(spark, str(tmp_path / "p")).count() == 1


LOG = "job_id string, seq long, status string, progress double, error string, updated_at timestamp"


def log_rows():
    at = lambda m: TS + dt.timedelta(minutes=m)
    return [("j", 1, "crawling", 20.0, None, at(0)), ("j", 2, "completed", 100.0, None, at(3)), ("k", 3, "failed", None, "boom", at(1)),
            ("k", 4, "crawling", 20.0, None, at(1))]


def test_job_state(frame, values):
    log = frame(LOG, *log_rows())
    got = {r["job_id"]: (r["status"], r["error"], r["completed_at"] is None) for r in J.latest_job_state(log).collect()}
    assert got == {"j": ("completed", None, False), "k": ("crawling", None, True)}
    assert {(r["job_id"], r["seq"]): r["seconds"] for r in J.stage_durations(log).collect()}[("j", 1)] == 180.0
    assert J.stage_durations(log, range_rows=1).exceptAll(J.stage_durations(log)).isEmpty()
    jobs = frame("job_id string, status string", ("j", "x"))
    assert values(A.lookup_jobs(frame("job_id string", ("j",), ("q",)), jobs)) == [("j", "x", True), ("q", None, False)]
    counted = A.job_results(jobs, pages=frame("job_id string", ("j",), ("j",)), drafts=frame("job_id string", ("z",)))
    assert values(counted) == [("j", "x", 2, 0)]


def test_streamed_states_equal_batch(spark, frame, tmp_path):
    for n, part in enumerate((log_rows()[:2], log_rows()[2:])):
        frame(LOG, *part).coalesce(1).write.parquet(str(tmp_path / "log" / f"b{n}"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "log"))
    J.start_state_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert J.read_states(spark, str(tmp_path / "out")).exceptAll(J.latest_job_state(frame(LOG, *log_rows()))).isEmpty()


def test_folded_states(spark, frame, tmp_path):
    path = str(tmp_path / "states")
    rows = log_rows()

    def batch(i, *part):
        J.latest_job_state(frame(LOG, *part)).write.parquet(f"{path}/batch={i}")

    batch(0, rows[0])
    batch(1, *rows[2:])
    before = sorted(map(tuple, J.read_states(spark, path).collect()))
    assert J.fold_states(spark, path) == 1
    assert sorted(map(tuple, J.read_states(spark, path).collect())) == before
    (tmp_path / "states-folded" / "upto=9").mkdir()  # a fold that did not finish
    batch(2, *rows[:2])
    got = J.read_states(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, J.latest_job_state(frame(LOG, *rows)).collect()))
    assert "PartitionFilters: [isnotnull(batch" in got._jdf.queryExecution().executedPlan().toString()
    assert J.fold_states(spark, path) == 2 and J.read_states(spark, path).count() == 2


def test_streamed_pages_once(spark, frame, tmp_path):
    schema = "page_id long, url string, html string"
    frame(schema, (1, "https://s/a", "<title>A</title>"), (2, "https://s/a", "<p>again"), (3, "https://s/b", "<p>b c")).coalesce(1).write.parquet(
        str(tmp_path / "in"))
    parsed = intake.parse_stream(intake.stream_pages(spark, str(tmp_path / "in")))
    intake.write_stream(parsed, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["url"] for r in rows.collect()) == ["https://s/a", "https://s/b"]


def test_pages_taken_once_however_late(spark, frame, tmp_path):
    schema, source, out = "page_id long, url string, html string", str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*rows):
        frame(schema, *rows).coalesce(1).write.mode("append").parquet(source)

    def take(checkpoint):
        intake.take_pages(intake.arriving_pages(spark, source), out, str(tmp_path / checkpoint)).awaitTermination()
        return [(r["crawl_seq"], r["url"], r["title"]) for r in intake.read_pages_taken(spark, out).collect()]

    arrive((2, "https://s/a", "<title>second</title>"), (1, "https://s/a", "<title>A</title>"), (1, "https://s/a", "<title>A</title>"),
           (3, "https://s/b", "<title>B</title>"), (4, None, "<title>none</title>"), (5, "https://s/empty", ""))
    first = [(1, "https://s/a", "A"), (3, "https://s/b", "B"), (4, None, "none")]
    key = lambda rows: sorted(map(repr, rows))
    assert key(take("ck")) == key(first)
    arrive((9, "https://s/a", "<title>late</title>"), (10, "https://s/c", "<title>C</title>"))
    both = first + [(10, "https://s/c", "C")]
    assert key(take("ck")) == key(both)
    # the last batch fails before its commit and is run again
    (tmp_path / "ck" / "commits" / "1").unlink()
    (tmp_path / "ck" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert key(take("ck")) == key(both)
    # a stream that knows nothing of the first
    assert key(take("other")) == key(both)


@pytest.mark.parametrize("folder", [True, False])
def test_streams_read_tables_stored_as_a_folder_or_a_file(spark, frame, tmp_path, folder):
    frame("page_id long, url string, html string", (1, "https://s/a", "<p>one two"), (2, "https://s/b", "<p>three"), (3, "https://s/c", None)).coalesce(
        1).write.parquet(str(tmp_path / "pages.parquet"))
    frame("event_id long, ts timestamp, user_id long, event_type string, props string", (1, TS, 7, "click", None)).coalesce(
        1).write.parquet(str(tmp_path / "events.parquet"))
    if not folder:
        for name in ("pages", "events"):
            (part,) = (tmp_path / f"{name}.parquet").glob("part-*.parquet")
            (tmp_path / "files").mkdir(exist_ok=True)
            (tmp_path / "files" / f"{name}.parquet").write_bytes(part.read_bytes())
    source = str(tmp_path if folder else tmp_path / "files")
    for name in ("streamed_pages", "pages_taken_once"):
        assert sorted((r["url"], r["word_count"]) for r in QUERIES[name](spark, source).collect()) == [("https://s/a", 2), ("https://s/b", 1)]
    assert [r["job_id"] for r in QUERIES["streamed_job_states"](spark, source).collect()] == ["7"]


def test_no_join_is_hinted(spark, frame):
    """Robots files that repeat, and a dictionary made by explode, compress to next to nothing: their estimates prove nothing."""
    rules = spark.range(2000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), F.explode(F.sequence(F.lit(1), F.lit(50))).alias("seq"),
                                     F.lit(False).alias("allow"), F.lit("/" + "x" * 200).alias("prefix"))
    urls = frame("url string", ("https://h1/x",))
    assert "ResolvedHint" not in match_rules(urls, rules)._jdf.queryExecution().analyzed().toString()
    pages = frame("site_id string, url string, text_content string", ("s", "u", "a b c d e"))
    terms = spark.range(1).select(F.explode(F.array(F.lit("B C"), F.lit("a b c d e"))).alias("term"), F.lit("ORG").alias("label"))
    found = X.match_entities(pages, terms)
    assert "ResolvedHint" not in found._jdf.queryExecution().analyzed().toString()
    assert sorted(r["term"] for r in found.collect()) == ["B C", "a b c d e"]


class _Context:
    """Stands for a context whose master and checkpoint folder the test chooses."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, context, configured=None):
        self.sparkContext, self.conf = context, {"spark.checkpoint.dir": configured}


def test_shared_folder_choice():
    assert shared_folder(_Session(_Context("yarn"), "hdfs://x/ck")) == "hdfs://x/ck"
    assert shared_folder(_Session(_Context("yarn", "hdfs://y"))) == "hdfs://y"
    local = _Session(_Context("local[2]"))
    assert shared_folder(local) == shared_folder(local)
    with pytest.raises(ValueError):
        shared_folder(_Session(_Context("yarn")))


def test_durable_writes_under_the_shared_folder(spark):
    plan = durable(spark.range(3))
    assert plan.count() == 3 and shared_folder(spark).split(":")[-1] in plan.inputFiles()[0]


def test_tables_can_be_dropped(spark):
    kept = WRITTEN[:]
    WRITTEN.clear()
    path = durable(spark.range(3)).inputFiles()[0]
    assert drop_tables(spark) == 1 and not WRITTEN
    WRITTEN.extend(kept)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_inputs_are_spread_by_setting_only(spark):
    one = spark.range(10).coalesce(1)
    assert spread(one, "id") is one
    spark.conf.set(INPUT_PARTITIONS, "3")
    try:
        assert spread(one, "id")._jdf.queryExecution().toRdd().getNumPartitions() == 3
    finally:
        spark.conf.unset(INPUT_PARTITIONS)


def test_components_shrink(spark, frame, monkeypatch):
    """A long chain of names in no order, and a hub: rounds write less and less, not every node again."""
    rng = random.Random(7)
    names = [f"n{i:03d}" for i in rng.sample(range(600), 300)]
    links = [(x, i + k) for i, x in enumerate(names) for k in (0, 1)] + [(f"z{i}", -1) for i in range(60)] * 2
    rows = [(("s" if n[0] == "n" else None, n), f"g{s}") for n, s in links] + [(None, "g5"), (("s", "alone"), "own"), (("s", "unlinked"), None)]
    written, plain = [], K.durable

    def counting(df):
        table = plain(df)
        written.append(table.count())
        return table

    monkeypatch.setattr(K, "durable", counting)
    got = K.connected_labels(frame("node struct<site_id:string,term:string>, sig string", *rows)).collect()
    assert {(r["node"]["term"], r["label"]["term"]) for r in got} == {
        *((n, min(names)) for n in names), *((f"z{i}", "z0") for i in range(60)), ("alone", "alone")}
    assert len(got) == 361 and sum(written) <= 7 * len(rows)
