"""Keyword tables: candidate terms, scores, clusters, gaps, calendar, draft checks.

The data model fixes the fields of these tables; how they are filled is this engine's choice and
is stated at each operator.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..lexicons import NOUN_STOPWORDS
from ..functions.urls import url_join, url_part, url_root
from ..session import durable
from .grams import frequent_grams, known_grams, normal_term
from .ranking import top_n
from .similar import similar_sets

# Content type per dominant intent, so that the default content mix can be filled.
INTENT_CONTENT = {
    "informational": "blog", "commercial": "service", "transactional": "product", "navigational": "landing",
}

# Characters of text whose terms one task counts: about a million terms.
TERM_CHARS = 4_000_000
# Characters of text whose terms one task makes: their rows fit its memory before they are shuffled.
PAGE_CHARS = 64_000_000
# Stands before a run of terms once for each word whose terms another run has; no word begins with it.
RUN_MARK = "+"


def page_terms(pages: DataFrame, n: tuple[int, int] = (1, 3), stopwords: Sequence[str] = NOUN_STOPWORDS) -> DataFrame:
    """Distinct n-grams of each page that neither start nor end with a stop word."""
    return pages.select("site_id", "url", T.plain_tokens("text_content").alias("_t")).select(
        "site_id", "url", F.explode(F.array_distinct(T.ngrams(F.col("_t"), *n, edge_stopwords=stopwords))).alias("term"))


def term_runs(pages: DataFrame, n: tuple[int, int] = (1, 3), stopwords: Sequence[str] = NOUN_STOPWORDS) -> DataFrame:
    """The terms of :func:`page_terms`, those of a page that one word begins as one row: ``site_id, run``.

    A run is the longest term from its word on; the shorter ones are its beginnings. A page's runs are sorted, so a beginning that the page
    has in several runs is one of the run before: such words are left to that run, and a mark for each of them precedes this one.
    """
    low, high = n
    listed = ", ".join(T.sql_literal(w) for w in stopwords)

    def open_edge(word: str) -> str:
        return f"{word} not in ({listed})" if stopwords else "true"

    # Each word is followed by a blank, so that one run begins another only where a word ends.
    word = ["rw", *[f"get(rt, ri + {k})" for k in range(1, high)]]
    longest = " ".join(f"when ri + {k} <= size(rt) and {open_edge(word[k - 1])} then concat_ws(' ', {', '.join(word[:k])}, '')" for k in range(high, low - 1, -1))
    every = f"filter(transform(rt, (rw, ri) -> if({open_edge('rw')}, case {longest} end, null)), rx -> rx is not null)"
    shared = " ".join(f"when not startswith(get(rs, ri - 1), concat(substring_index(rx, ' ', {k + 1}), ' ')) then concat('{RUN_MARK * k}', rx)" for k in range(high))
    new = T.sql_let(f"sort_array({every}, false)", "rs", "filter(transform(rs, (rx, ri) -> case when ri = 0 then rx when startswith(get(rs, ri - 1), rx) then null "
                    f"{shared} end), rx -> rx is not null)")
    # The outer form: from a plain one Spark infers filters on the array, each of which makes it once more.
    return pages.select("site_id", F.explode_outer(T.apply_sql(T.plain_tokens("text_content"), "rt", new)).alias("run")).filter(F.col("run").isNotNull())


def _run_words() -> Column:
    return F.ltrim(F.col("run"), F.lit(RUN_MARK))


def _first_word() -> Column:
    return F.substring_index(_run_words(), " ", 1)


def run_terms(runs: DataFrame, n: tuple[int, int] = (1, 3), stopwords: Sequence[str] = NOUN_STOPWORDS) -> DataFrame:
    """``site_id, _first, term``: the terms that rows of :func:`term_runs` stand for, with their first word."""
    cut = runs.select("site_id", _first_word().alias("_first"), _run_words().alias("_words"), (F.length("run") - F.length(_run_words())).alias("_known"))

    def term(k: int) -> Column:
        beginning = F.substring_index("_words", " ", k)
        whole = F.length("_words") > F.length(beginning)
        edge = ~F.substring_index(beginning, " ", -1).isin(*stopwords) if stopwords and k > 1 else F.lit(True)
        return F.when((F.col("_known") < k) & whole & edge, beginning)

    return cut.select("site_id", "_first", F.explode(F.array(*[term(k) for k in range(n[0], n[1] + 1)])).alias("term")).filter(F.col("term").isNotNull())


def candidate_terms(pages: DataFrame, n: tuple[int, int] = (1, 3), stopwords: Sequence[str] = NOUN_STOPWORDS,
                    min_volume: int = 1) -> DataFrame:
    """``site_id, term, volume``: number of pages that contain each term, for terms of ``min_volume`` pages or more.

    Terms are distinct within a page first, so document frequency is a plain count. Most terms occur on one page: counting them before
    the shuffle merges next to nothing and outgrows a task's memory. So terms are dealt first, those of a page with the same first word
    in runs (:func:`term_runs`), to as many partitions as the length of the texts asks for (:data:`TERM_CHARS`), and each is counted where it
    lies; counts that would not fit spill. Pages that lie in larger parts than :data:`PAGE_CHARS` are dealt before that.
    With a ``min_volume`` above 1 only n-grams whose parts reach it are counted (:func:`frequent_grams`).
    """
    if min_volume > 1:
        tokens = durable(pages.select("site_id", T.plain_tokens("text_content").alias("_t")))
        levels = frequent_grams(tokens, "_t", ["site_id"], n[1], min_volume)[n[0] - 1:]
        words = F.split("term", " ")
        return reduce(DataFrame.unionByName, levels).filter(
            ~F.get(words, F.lit(0)).isin(*stopwords) & ~F.element_at(words, -1).isin(*stopwords))
    lengths = pages.groupBy(F.spark_partition_id().alias("_p")).agg(F.sum(F.length("text_content")).alias("n"))
    chars, most = (x or 0 for x in lengths.agg(F.sum("n"), F.max("n")).first())
    if most > PAGE_CHARS:
        pages = pages.repartition(-(-chars // PAGE_CHARS), "site_id", "url")
    parts = max(pages.sparkSession.sparkContext.defaultParallelism, -(-chars // TERM_CHARS))
    runs = term_runs(pages, n, stopwords).repartition(parts, "site_id", _first_word())
    return run_terms(runs, n, stopwords).groupBy("site_id", "_first", "term").agg(F.count(F.lit(1)).alias("volume")).drop("_first")


def score_keywords(df: DataFrame) -> DataFrame:
    """``score = ln(1 + volume) * (1 - ads_competition) * (1 - difficulty_proxy / 100)``."""
    return df.withColumn(
        "score", F.log1p("volume") * (1 - F.col("ads_competition")) * (1 - F.col("difficulty_proxy") / 100))


def filter_keywords(df: DataFrame, min_volume: int = 10, max_competition: float = 0.8,
                    max_difficulty: float = 70.0) -> DataFrame:
    """Keywords inside the configured thresholds."""
    return df.filter((F.col("volume") >= min_volume) & (F.col("ads_competition") <= max_competition)
                     & (F.col("difficulty_proxy") <= max_difficulty))


def _term_hits(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct ``site_id, term`` of ``keys`` (normalised terms of any length) that occur on a page of their site."""
    keys = durable(keys.filter(F.col("term") != "").distinct())
    tokens = pages.select("site_id", T.plain_tokens("text_content").alias("_t"))
    return known_grams(tokens, "_t", keys, "term", ["site_id"]).distinct().join(keys, ["site_id", "term"], "left_semi")


def site_evidence(keywords: DataFrame, pages: DataFrame) -> DataFrame:
    """Keywords whose words occur together on a page of their site, any case, edge punctuation aside."""
    marked = keywords.withColumn("_term", normal_term("term"))
    hits = _term_hits(marked.select("site_id", F.col("_term").alias("term")), pages)
    return marked.join(hits.withColumnRenamed("term", "_term"), ["site_id", "_term"], "left_semi").select(*keywords.columns)


def verify_keywords(keywords: DataFrame, pages: DataFrame) -> DataFrame:
    """Fill ``verified_against_site`` and ``cannot_verify_note``: does the term occur on a page of its site? Terms may have any
    number of words; terms and pages are compared as lower-case words without edge punctuation."""
    marked = keywords.withColumn("_term", normal_term("term"))
    found = _term_hits(marked.select("site_id", F.col("_term").alias("term")), pages).select(
        "site_id", F.col("term").alias("_term"), F.lit(True).alias("_hit"))
    return (
        marked.join(found, ["site_id", "_term"], "left")
        .withColumn("verified_against_site", F.coalesce("_hit", F.lit(False)))
        .withColumn("cannot_verify_note", F.when(F.col("_hit").isNull(), "term not found on site"))
        .drop("_term", "_hit")
    )


# --- clusters ------------------------------------------------------------------------------------

def connected_labels(links: DataFrame) -> DataFrame:
    """``node, label``: smallest node of each connected component of a node-signature table.

    Nodes are numbered in their order once, so what follows compares and shuffles two whole numbers a row. Each signature links its nodes
    to the least of them: pairs of nodes that share a signature are never formed. Each round hangs every node on its least
    neighbour, follows these up to the top (each step halves the distance) and puts the tops in place of the nodes, so links inside a tree
    and double ones go. Two rounds at least halve the nodes that still have links, and the least node of a component stays
    to the end. A hot node or signature only ever contributes one row to the joined side, which AQE can split.
    """
    links = durable(links.select("node", "sig").filter(F.col("node").isNotNull() & F.col("sig").isNotNull()))
    nodes = durable(links.select("node").distinct().orderBy("node").withColumn("id", F.monotonically_increasing_id()))
    numbered = durable(links.join(nodes, "node").select("id", "sig"))
    least = numbered.groupBy("sig").agg(F.min("id").alias("low"))
    edges = durable(numbered.join(least, "sig").filter("id <> low").select("id", "low").distinct())
    tops: list[DataFrame] = []
    while not edges.isEmpty():
        top = durable(edges.groupBy("id").agg(F.min("low").alias("top")))
        while True:
            above = top.select(F.col("id").alias("top"), F.col("top").alias("_next"))
            stepped = durable(top.join(above, "top", "left").select("id", F.coalesce("_next", "top").alias("top"), F.col("_next").isNotNull().alias("_moved")))
            top = stepped.select("id", "top")
            if stepped.filter("_moved").isEmpty():
                break
        tops.append(top)
        ends = edges.join(top, "id", "left").select(F.coalesce("top", "id").alias("a"), F.col("low").alias("id")).join(
            top, "id", "left").select("a", F.coalesce("top", "id").alias("b"))
        edges = durable(ends.filter("a <> b").select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("low")).distinct())
    if not tops:
        return nodes.select("node", F.col("node").alias("label"))
    last = tops.pop()
    while tops:
        # Nodes that were tops in this round have their rows in a later one.
        last = durable(last.unionByName(tops.pop().join(last.select(F.col("id").alias("top"), F.col("top").alias("_last")), "top", "left").select(
            "id", F.coalesce("_last", "top").alias("top"))))
    label = nodes.select(F.col("id").alias("top"), F.col("node").alias("label"))
    return nodes.join(last, "id", "left").withColumn("top", F.coalesce("top", "id")).join(label, "top").select("node", "label")


def cluster_keywords(df: DataFrame, threshold: float = 0.5, min_size: int = 3) -> DataFrame:
    """Adds ``cluster_id`` (smallest member term): single-link groups of terms whose words have a Jaccard similarity of
    at least ``threshold``.

    Works per site. Groups under ``min_size`` stay unclustered (NULL). Terms without words are alike. See :mod:`.similar`.
    """
    # The input is evaluated once; what follows reads it as a table.
    rows = durable(df.drop("cluster_id"))
    words = F.array_sort(F.array_distinct(T.words(F.lower("term"))))
    terms = rows.select("site_id", "term", words.alias("words")).distinct()
    # Terms of the same words are one node, named by the least of them, so the least node of a group is its least term.
    sets = durable(terms.groupBy("site_id", "words").agg(F.min("term").alias("least")).select(
        F.struct("site_id", F.col("least").alias("term")).alias("node"), "site_id", "words"))
    labels = connected_labels(similar_sets(sets, threshold))
    own = sets.join(labels, "node", "left").select("site_id", "words", F.coalesce("label", "node").alias("label"))
    members = durable(terms.join(own, ["site_id", "words"]).select("site_id", "term", F.col("label.term").alias("cluster_id")))
    sizes = members.groupBy("site_id", "cluster_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_size)
    kept = members.join(sizes.select("site_id", "cluster_id"), ["site_id", "cluster_id"], "left_semi")
    return rows.join(kept, ["site_id", "term"], "left")


def attach_clusters(keywords: DataFrame, clusters: DataFrame) -> DataFrame:
    """Keywords with the label and pillar of their cluster; unclustered keywords stay."""
    return keywords.join(
        clusters.select("site_id", F.col("id").alias("cluster_id"), "label", "pillar"),
        ["site_id", "cluster_id"], "left")


def mark_primary(keywords: DataFrame) -> DataFrame:
    """``is_primary``: the term of highest volume of each cluster (ties: first alphabetically).

    The winner is an aggregate joined back by term, so a large cluster is never sorted in one task.
    """
    best = (
        keywords.filter(F.col("cluster_id").isNotNull()).groupBy("site_id", "cluster_id")
        .agg(F.min_by("term", F.struct(-F.col("volume"), F.col("term"))).alias("term"))
        .withColumn("_best", F.lit(True))
    )
    return keywords.drop("is_primary").join(best, ["site_id", "cluster_id", "term"], "left").withColumn(
        "is_primary", F.coalesce("_best", F.lit(False))).drop("_best")


def cluster_rollup(keywords: DataFrame, n_primary: int = 3) -> DataFrame:
    """One row per cluster: volumes, dominant intent, pillar and top terms.

    Intent votes are counted per allowed value; ties go to the first intent by name. ``primary_terms``
    are the ``n_primary`` terms of highest volume, cut before they are gathered.
    """
    members = keywords.filter(F.col("cluster_id").isNotNull())
    keys = ["site_id", "cluster_id"]
    totals = members.groupBy(*keys).agg(
        F.avg("volume").alias("avg_volume"), F.sum(F.col("volume").cast("long")).alias("total_volume"),
        F.count(F.lit(1)).alias("members_count"),
        F.min_by("term", F.struct(-F.col("volume"), F.col("term"))).alias("pillar"))
    votes = members.groupBy(*keys, "intent").agg(F.count(F.lit(1)).alias("_n"))
    intent = votes.groupBy(*keys).agg(
        F.min_by("intent", F.struct(-F.col("_n"), F.col("intent"))).alias("dominant_intent"))
    top = top_n(members.select(*keys, "term", "volume"), keys, [-F.col("volume"), "term"], n_primary, "_r")
    primary = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "term"))).alias("_t")).select(
        *keys, F.transform("_t", lambda t: t["term"]).alias("primary_terms"))
    return (
        totals.join(intent, keys).join(primary, keys)
        .withColumn("content_type_suggestion", suggest_content_type(F.col("dominant_intent")))
        .withColumnRenamed("cluster_id", "id")
    )


def label_terms(keywords: DataFrame) -> DataFrame:
    """Class-based TF-IDF of words per cluster: ``tf * ln(1 + A / f)``.

    ``tf`` counts a word in the cluster's terms, ``f`` in all clusters of the site, ``A`` is the mean number
    of words per cluster of the site.
    """
    tokens = keywords.filter(F.col("cluster_id").isNotNull()).select(
        "site_id", "cluster_id", F.explode(T.words(F.lower("term"))).alias("word"))
    tf = tokens.groupBy("site_id", "cluster_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    overall = tf.groupBy("site_id", "word").agg(F.sum("tf").alias("f"))
    mean = tf.groupBy("site_id").agg((F.sum("tf") / F.count_distinct("cluster_id")).alias("a"))
    return tf.join(overall, ["site_id", "word"]).join(mean, "site_id").select(
        "site_id", "cluster_id", "word", (F.col("tf") * F.log1p(F.col("a") / F.col("f"))).alias("weight"))


def label_clusters(keywords: DataFrame, n_words: int = 3) -> DataFrame:
    """``site_id, id, label``: the words of highest weight of each cluster, joined with blanks."""
    keys = ["site_id", "cluster_id"]
    best = top_n(label_terms(keywords), keys, [-F.round("weight", 9), "word"], n_words, "_r")
    return best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "word"))).alias("_w")).select(
        "site_id", F.col("cluster_id").alias("id"),
        F.array_join(F.transform("_w", lambda w: w["word"]), " ").alias("label"))


def suggest_content_type(intent) -> Column:
    """Content type for a dominant intent."""
    names = F.create_map(*[F.lit(x) for pair in INTENT_CONTENT.items() for x in pair])
    return F.coalesce(F.try_element_at(names, intent if isinstance(intent, Column) else F.col(intent)), F.lit("blog"))


# --- competitors ---------------------------------------------------------------------------------

def compare_ranks(ranks: DataFrame) -> DataFrame:
    """``site_id, keyword, client_position, best_rival, competitors_ranking`` in one pass over ``ranks`` (``site_id, keyword,
    domain, position, own``; ``own`` marks the client's rows).

    The map holds the best position of each competing domain, so it is as long as a site's list of competitors; it
    is empty where no competitor ranks.
    """
    keys = ["site_id", "keyword"]
    best = ranks.groupBy(*keys, "domain", "own").agg(F.min("position").cast("int").alias("position"))
    entries = F.array_sort(F.collect_list(F.when(~F.col("own"), F.struct("domain", "position"))))
    return best.groupBy(*keys).agg(
        F.min(F.when(F.col("own"), F.col("position"))).alias("client_position"),
        F.min(F.when(~F.col("own"), F.col("position"))).alias("best_rival"),
        F.map_from_entries(entries).alias("competitors_ranking"))


def gap_analysis(ranks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Keywords of each site where a rival ranks and the client does not (missing) or ranks worse (underperforming), with the map
    of competitors; ``volumes`` has ``site_id, keyword, volume``.

    ``gap_score = volume * (1 / best_rival - 1 / client_position)``, the client term 0 when missing.
    """
    client_term = F.coalesce(1 / F.col("client_position"), F.lit(0.0))
    score = F.greatest(F.col("volume") * (1 / F.col("best_rival") - client_term), F.lit(0.0))
    return (
        compare_ranks(ranks)
        .filter(F.col("best_rival").isNotNull()
                & (F.col("client_position").isNull() | (F.col("client_position") > F.col("best_rival"))))
        .join(volumes, ["site_id", "keyword"])
        .withColumn("gap_score", score)
        .withColumn("opportunity_type",
                    F.when(F.col("client_position").isNull(), "missing").otherwise("underperforming"))
        .select("site_id", "keyword", "volume", "competitors_ranking", "client_position", "best_rival", "gap_score",
                "opportunity_type")
    )


# --- calendar ------------------------------------------------------------------------------------

def assign_weeks(items: DataFrame, quota: Mapping[str, int], weeks: int = 36) -> DataFrame:
    """Weeks 1.. per site for the best-scored items within each content type's quota.

    Both cuts (quota, weeks) happen before their shuffle, so a site's size does not matter. Items of types that the
    quota does not name cannot be planned; :func:`unquoted_types` reports them.
    """
    order = [-F.col("score"), "topic"]
    widest = max(quota.values())
    ranked = top_n(items.filter(F.col("content_type").isin(*quota)), ["site_id", "content_type"], order, widest, "_q")
    limits = F.create_map(*[F.lit(x) for pair in quota.items() for x in pair])
    within = ranked.filter(F.col("_q") <= F.element_at(limits, F.col("content_type"))).drop("_q")
    return top_n(within, ["site_id"], order, weeks, "week")


def unquoted_types(items: DataFrame, quota: Mapping[str, int]) -> DataFrame:
    """``site_id, content_type, items``: how many items have a content type that the quota does not plan."""
    return items.filter(~F.coalesce(F.col("content_type").isin(*quota), F.lit(False))).groupBy("site_id", "content_type").agg(
        F.count(F.lit(1)).alias("items"))


def assign_priority(items: DataFrame) -> DataFrame:
    """Thirds of a site's calendar by score: high, medium, low.

    Runs on calendar rows, of which a site has at most one per week.
    """
    third = F.ntile(3).over(Window.partitionBy("site_id").orderBy(-F.col("score"), F.col("topic")))
    return items.withColumn("_t", third).withColumn(
        "priority", F.when(F.col("_t") == 1, "high").when(F.col("_t") == 2, "medium").otherwise("low")).drop("_t")


def secondary_keywords(keywords: DataFrame, most: int = 6) -> DataFrame:
    """The next ``most`` members of each cluster after its pillar, by volume."""
    keys = ["site_id", "cluster_id"]
    members = keywords.filter(F.col("cluster_id").isNotNull()).select(*keys, "term", "volume")
    top = top_n(members, keys, [-F.col("volume"), "term"], most + 1, "_r").filter(F.col("_r") > 1)
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "term"))).alias("_t")).select(
        *keys, F.transform("_t", lambda t: t["term"]).alias("secondary_keywords"))


def calendar_items(clusters: DataFrame, keywords: DataFrame) -> DataFrame:
    """Clusters as items that a calendar can plan: those with at least three further members."""
    extra = secondary_keywords(keywords).filter(F.size("secondary_keywords") >= 3)
    return clusters.withColumnRenamed("id", "cluster_id").join(extra, ["site_id", "cluster_id"]).select(
        "site_id", "cluster_id", F.col("pillar").alias("topic"), F.col("content_type_suggestion").alias("content_type"),
        F.col("pillar").alias("primary_keyword"), "secondary_keywords", F.col("total_volume").cast("double").alias("score"))


def content_calendar(clusters: DataFrame, keywords: DataFrame, quota: Mapping[str, int], weeks: int = 36,
                     hours: float = 4.0) -> DataFrame:
    """One item per week and site from its clusters, best total volume first.

    ``idx`` is the item's position in its site's calendar; briefs and drafts carry it on. Clusters with fewer than three
    further members cannot give three secondary keywords and are left out.
    """
    planned = assign_priority(assign_weeks(calendar_items(clusters, keywords), quota, weeks))
    return planned.select(
        "site_id", F.col("week").cast("long").alias("idx"), "week", "topic", "content_type", "primary_keyword",
        "secondary_keywords", "cluster_id", F.lit(None).cast("string").alias("target_url"),
        F.lit(hours).alias("estimated_effort_hours"), "priority")


def content_mix(calendar: DataFrame, quota: Mapping[str, int]) -> DataFrame:
    """Planned items per content type against the quota, types without items included."""
    used = calendar.groupBy("site_id", "content_type").agg(F.count(F.lit(1)).alias("planned"))
    sites = calendar.select("site_id").distinct()
    wanted = sites.select("site_id", F.inline(F.array(*[
        F.struct(F.lit(t).alias("content_type"), F.lit(n).alias("quota")) for t, n in quota.items()])))
    return wanted.join(used, ["site_id", "content_type"], "left").select(
        "site_id", "content_type", "quota", F.coalesce("planned", F.lit(0)).alias("planned"))


# --- drafts --------------------------------------------------------------------------------------

# US spelling to UK spelling for the spelling check.
UK_SPELLINGS = {
    "color": "colour", "favor": "favour", "behavior": "behaviour", "center": "centre", "theater": "theatre",
    "organize": "organise", "optimize": "optimise", "analyze": "analyse", "defense": "defence",
    "catalog": "catalogue", "dialog": "dialogue", "traveling": "travelling", "modeling": "modelling",
}


def us_forms(spellings: Mapping[str, str] = UK_SPELLINGS) -> list[str]:
    """The US base forms and their inflections: plural, past, ``-ing`` and agent forms, those of ``-ize`` also with ``-ization``."""
    forms = set()
    for word in spellings:
        stem = word[:-1] if word.endswith("e") else word
        forms |= {word, f"{word}s", f"{stem}ed", f"{stem}ing", f"{stem}er", f"{stem}ers"}
        if word.endswith("ize"):
            forms |= {f"{stem}ation", f"{stem}ations"}
        if word.endswith("ing"):
            forms |= {f"{word[:-3]}ed", f"{word[:-3]}er", f"{word[:-3]}ers"}
    return sorted(forms)


# Markdown targets and bare http(s) URLs of a text.
_LINK = r"\]\(([^()\s]+)|(https?://[^\s()<>\"']+)"


def draft_links(drafts: DataFrame, key: str = "idx") -> DataFrame:
    """``site_id, key, target`` of the links in drafts: Markdown targets, relative ones too, and bare URLs without the
    punctuation that closes a sentence."""
    found = F.regexp_extract_all("content", F.lit(_LINK), F.lit(0))
    bare = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\]\(", ""), r"[.,;:!?]+$", ""))
    return drafts.select("site_id", key, F.explode(F.array_distinct(bare)).alias("target"))


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links to the own site (``site_id, target``, relative or absolute) that lead to no stored page. Links to
    other hosts and other schemes are not the site's to break."""
    roots = pages.groupBy("site_id").agg(F.concat(url_root(F.min("url")), F.lit("/")).alias("_root"))
    whole = links.join(roots, "site_id").withColumn("_to", url_join("_root", "target"))
    own = whole.filter(F.coalesce(url_part("_to", "AUTHORITY") == url_part("_root", "AUTHORITY"), F.lit(False)))
    known = pages.select("site_id", F.col("url").alias("_to")).distinct()
    return own.join(known, ["site_id", "_to"], "left_anti").select(*links.columns)


def reading_ease(text) -> Column:
    """Flesch reading ease. Syllables are vowel runs per word, an approximation for English."""
    count = T.word_count(text)
    sentences = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))
    syllables = F.regexp_count(F.lower(text), F.lit("[aeiouy]+"))
    score = 206.835 - 1.015 * (count / sentences) - 84.6 * (syllables / count)
    return F.when(count > 0, score)


def draft_qa(drafts: DataFrame, pages: DataFrame | None = None, spellings: Mapping[str, str] = UK_SPELLINGS,
             key: str = "idx") -> DataFrame:
    """Word count, readability, UK spelling and link validity of each draft.

    A draft is valid when none of its links to the own site is broken; see :func:`draft_links` and :func:`broken_links`.
    """
    text = F.col("content")
    us_words = rf"(?i)(?:^|[^a-z])(?:{'|'.join(us_forms(spellings))})(?:[^a-z]|$)"
    checked = drafts.select(
        "site_id", key, T.word_count(text).alias("word_count"), reading_ease(text).alias("readability_score"),
        (~text.rlike(us_words)).alias("uk_english_verified"))
    if pages is None:
        return checked
    broken = broken_links(draft_links(drafts, key), pages).groupBy("site_id", key).agg(F.count(F.lit(1)).alias("_broken"))
    return checked.join(broken, ["site_id", key], "left").withColumn(
        "internal_links_validated", F.col("_broken").isNull()).drop("_broken")
