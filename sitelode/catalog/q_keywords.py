"""Keywords, clusters, competitors, calendar and draft checks."""

from pyspark.sql import functions as F

from ..config import RunConfig
from ..lexicons import NOUN_STOPWORDS
from ..operators import keywords as K
from ..session import durable
from ..operators.ranking import number_rows, tiles
from . import inputs as I
from .q_facets import _TOKENS
from .registry import query

_STOP = "|".join(NOUN_STOPWORDS)
_TERMS = f"""dw AS (SELECT site_id, url, {_TOKENS.format('text_content')} AS t FROM d), di AS (SELECT site_id, url, t, unnest(range(1, len(t) + 1)) AS i FROM dw),
grams AS (SELECT DISTINCT site_id, url, unnest([array_to_string(t[i:i + n - 1], ' ') for n in [1, 2, 3] if i + n - 1 <= len(t)]) AS term FROM di),
terms AS (SELECT site_id, term, count(*) AS volume FROM grams WHERE NOT regexp_matches(term, '^(?:{_STOP})(?: |$)|(?:^| )(?:{_STOP})$') GROUP BY 1, 2)"""


@query(f"WITH {I.DOCS}, {_TERMS} SELECT site_id, term, volume FROM terms")
def candidate_terms(spark, sf_dir):
    return K.candidate_terms(I.docs(spark, sf_dir))


@query(f"WITH {I.DOCS}, {_TERMS} SELECT site_id, term, volume FROM terms WHERE volume >= 5")
def frequent_terms(spark, sf_dir):
    return K.candidate_terms(I.docs(spark, sf_dir), min_volume=5)


_SCORE = "ln(1 + volume) * (1 - ads_competition) * (1 - difficulty_proxy / 100)"


@query(f"WITH {I.KEYWORDS} SELECT site_id, term, volume, round({_SCORE}, 6) AS score FROM k")
def keyword_scores(spark, sf_dir):
    return K.score_keywords(I.keywords(spark, sf_dir)).select("site_id", "term", "volume", F.round("score", 6).alias("score"))


@query(f"WITH {I.KEYWORDS} SELECT site_id, term FROM k WHERE volume >= 10 AND ads_competition <= 0.8 AND difficulty_proxy <= 70")
def keyword_thresholds(spark, sf_dir):
    return K.filter_keywords(I.keywords(spark, sf_dir)).select("site_id", "term")


def _site_terms(spark, sf_dir):
    """Keywords of documents: the first two and the first five words of every line, stored as a table."""
    lines = I.docs(spark, sf_dir).select("site_id", F.explode(F.split("text_content", "\n")).alias("line"))
    words = lines.select("site_id", K.T.plain_tokens("line").alias("w")).filter(F.size("w") >= 2)
    # Two words, some letters in capitals, with an end mark, five as they are.
    pair = words.select("site_id", F.explode(F.array_compact(F.array(
        F.concat(F.replace(F.array_join(F.slice("w", 1, 2), " "), F.lit("e"), F.lit("E")), F.lit("!")),
        F.when(F.size("w") >= 5, F.array_join(F.slice("w", 1, 5), " "))))).alias("term"))
    # A term counts for its own site and for the site with the reversed id, where it may be missing.
    other = F.concat(F.lit("src"), F.reverse(F.substr("site_id", F.lit(4))))
    return durable(pair.select(F.explode(F.array("site_id", other)).alias("site_id"), "term").distinct())


_SITE_TERMS = f"""pairs AS (SELECT site_id, unnest([array_to_string(w[1:2], ' ')] || CASE WHEN len(w) >= 5 THEN [array_to_string(w[1:5], ' ')] ELSE [] END) AS norm,
  unnest([replace(array_to_string(w[1:2], ' '), 'e', 'E') || '!'] || CASE WHEN len(w) >= 5 THEN [array_to_string(w[1:5], ' ')] ELSE [] END) AS term FROM (SELECT site_id, {_TOKENS.format('line')} AS w FROM (
  SELECT site_id, unnest(string_split(text_content, chr(10))) AS line FROM d)) WHERE len(w) >= 2),
st AS (SELECT site_id, term, norm FROM pairs UNION SELECT 'src' || reverse(site_id[4:]), term, norm FROM pairs),
g5 AS (SELECT DISTINCT site_id, unnest([array_to_string(t[i:i + n - 1], ' ') for n in [2, 5] if i + n - 1 <= len(t)]) AS norm FROM di)"""


@query(f"""WITH {I.DOCS}, {_TERMS}, {_SITE_TERMS}
SELECT site_id, term, g5.norm IS NOT NULL AS verified_against_site,
CASE WHEN g5.norm IS NULL THEN 'term not found on site' END AS cannot_verify_note FROM st LEFT JOIN g5 USING (site_id, norm)""")
def verified_keywords(spark, sf_dir):
    return K.verify_keywords(_site_terms(spark, sf_dir), I.docs(spark, sf_dir))


@query(f"""WITH {I.DOCS}, {_TERMS}, {_SITE_TERMS} SELECT site_id, term FROM st SEMI JOIN g5 USING (site_id, norm)""")
def site_evidence(spark, sf_dir):
    return K.site_evidence(_site_terms(spark, sf_dir), I.docs(spark, sf_dir))


def _components(terms: str, threshold: float) -> str:
    """SQL: ``cl`` has the cluster of each row of ``k`` (``site_id, term``), from all pairs of similar terms of a site."""
    return f"""WITH RECURSIVE {terms},
toks AS (SELECT site_id, term, list_distinct(string_split(term, ' ')) AS w FROM k),
link AS (SELECT a.site_id, a.term AS a, b.term AS b FROM toks a JOIN toks b ON a.site_id = b.site_id AND a.term <> b.term
  AND len(list_intersect(a.w, b.w)) >= {threshold} * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9),
walk AS (SELECT site_id, term, term AS seen FROM k UNION SELECT walk.site_id, walk.term, link.b FROM walk JOIN link ON link.site_id = walk.site_id AND link.a = walk.seen),
lab AS (SELECT site_id, term, min(seen) AS label FROM walk GROUP BY 1, 2),
cl AS (SELECT site_id, term, CASE WHEN count(*) OVER (PARTITION BY site_id, label) >= 3 THEN label END AS cluster_id FROM lab)"""


@query(f"{_components(I.KEYWORDS, 0.5)} SELECT site_id, term, cluster_id FROM cl")
def keyword_clusters(spark, sf_dir):
    return K.cluster_keywords(I.keywords(spark, sf_dir)).select("site_id", "term", "cluster_id")


@query(f"{_components(I.KEYWORDS, 0.25)} SELECT site_id, term, cluster_id FROM cl")
def loose_keyword_clusters(spark, sf_dir):
    return K.cluster_keywords(I.keywords(spark, sf_dir), 0.25).select("site_id", "term", "cluster_id")


_ROLL = f"""WITH {I.KEYWORDS}, votes AS (SELECT site_id, cluster_id, intent, count(*) AS n FROM k GROUP BY ALL),
dom AS (SELECT site_id, cluster_id, intent AS dominant_intent FROM votes QUALIFY row_number() OVER (PARTITION BY site_id, cluster_id ORDER BY n DESC, intent) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY site_id, cluster_id ORDER BY volume DESC, term) AS rn FROM k),
roll AS (SELECT site_id, cluster_id AS id, avg(volume) AS avg_volume, sum(volume)::BIGINT AS total_volume, count(*) AS members_count,
  max(term) FILTER (WHERE rn = 1) AS pillar, string_agg(term, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS primary_terms,
  string_agg(term, ',' ORDER BY rn) FILTER (WHERE rn BETWEEN 2 AND 7) AS secondary, count(*) FILTER (WHERE rn BETWEEN 2 AND 7) AS n_secondary FROM rk GROUP BY 1, 2),
clu AS (SELECT roll.*, dominant_intent, CASE dominant_intent WHEN 'informational' THEN 'blog' WHEN 'commercial' THEN 'service'
  WHEN 'transactional' THEN 'product' ELSE 'landing' END AS content_type_suggestion FROM roll JOIN dom ON dom.site_id = roll.site_id AND dom.cluster_id = roll.id)"""


@query(f"""{_ROLL} SELECT site_id, id, round(avg_volume, 6) AS avg_volume, total_volume, members_count, pillar, primary_terms,
dominant_intent, content_type_suggestion FROM clu""")
def cluster_rollups(spark, sf_dir):
    return K.cluster_rollup(I.keywords(spark, sf_dir)).select(
        "site_id", "id", F.round("avg_volume", 6).alias("avg_volume"), "total_volume", "members_count", "pillar",
        F.array_join("primary_terms", ",").alias("primary_terms"), "dominant_intent", "content_type_suggestion")


@query(f"""WITH {I.KEYWORDS}, tok AS (SELECT site_id, cluster_id, unnest(string_split(term, ' ')) AS word FROM k),
tf AS (SELECT site_id, cluster_id, word, count(*) AS tf FROM tok GROUP BY ALL),
f AS (SELECT site_id, word, sum(tf)::BIGINT AS f FROM tf GROUP BY ALL), m AS (SELECT site_id, sum(tf)::BIGINT / count(DISTINCT cluster_id) AS a FROM tf GROUP BY 1),
r AS (SELECT site_id, cluster_id, word, row_number() OVER (PARTITION BY site_id, cluster_id ORDER BY round(tf * ln(1 + a / f), 9) DESC, word) AS rn
  FROM tf JOIN f USING (site_id, word) JOIN m USING (site_id))
SELECT site_id, cluster_id AS id, string_agg(word, ' ' ORDER BY rn) AS label FROM r WHERE rn <= 3 GROUP BY 1, 2""")
def cluster_labels(spark, sf_dir):
    return K.label_clusters(I.keywords(spark, sf_dir))


@query(f"{_ROLL} SELECT k.site_id, term, pillar, pillar AS label FROM k JOIN clu ON clu.site_id = k.site_id AND clu.id = k.cluster_id")
def keywords_with_clusters(spark, sf_dir):
    k = I.keywords(spark, sf_dir)
    clusters = K.cluster_rollup(k).withColumn("label", F.col("pillar"))
    return K.attach_clusters(k, clusters).select("site_id", "term", "pillar", "label")


@query(f"""{_ROLL} SELECT site_id, term, rn = 1 AS is_primary FROM rk""")
def primary_keywords(spark, sf_dir):
    return K.mark_primary(I.keywords(spark, sf_dir)).select("site_id", "term", "is_primary")


@query(f"""WITH {I.KEYWORDS}, dom AS (SELECT DISTINCT intent FROM k) SELECT intent, CASE intent WHEN 'informational' THEN 'blog' WHEN 'commercial' THEN 'service'
WHEN 'transactional' THEN 'product' ELSE 'landing' END AS content_type FROM k""")
def suggested_content_types(spark, sf_dir):
    return I.keywords(spark, sf_dir).select("intent", K.suggest_content_type("intent").alias("content_type"))


def _client(spark, sf_dir):
    """Ranks as two sites see them: each is another nation's, and both have the same keywords."""
    sites = F.explode(F.array(*[F.struct(F.lit(f"client-{n}").alias("site_id"), F.lit(f"nation_{n}").alias("client")) for n in (0, 1)])).alias("x")
    return I.ranks(spark, sf_dir).select("domain", "keyword", "position", sites).select(
        "x.site_id", "keyword", "domain", "position", (F.col("domain") == F.col("x.client")).alias("own"))


def _volumes(spark, sf_dir):
    sold = I._sold(spark, sf_dir).groupBy(F.col("term").alias("keyword")).agg(F.count(F.lit(1)).cast("int").alias("volume"))
    return sold.withColumn("site_id", F.explode(F.array(F.lit("client-0"), F.lit("client-1"))))


_PAIRS = f"""WITH {I.RANKS}, s AS (SELECT unnest(['client-0', 'client-1']) AS site_id, unnest(['nation_0', 'nation_1']) AS client),
own AS (SELECT site_id, keyword, min(position) AS client_position FROM r JOIN s ON domain = client GROUP BY ALL),
best AS (SELECT site_id, keyword, min(position) AS best_rival,
  string_agg(domain || '=' || position, ',' ORDER BY domain) AS rivals FROM r JOIN s ON domain <> client GROUP BY ALL)"""


def _shown(df):
    """The map of competitors as text, domains in order."""
    entries = F.transform(F.array_sort(F.map_entries("competitors_ranking")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return df.withColumn("competitors_ranking", F.array_join(entries, ","))


@query(f"""{_PAIRS} SELECT coalesce(own.site_id, best.site_id) AS site_id, coalesce(own.keyword, best.keyword) AS keyword, client_position::INTEGER AS client_position,
best_rival::INTEGER AS best_rival, coalesce(rivals, '') AS competitors_ranking FROM own FULL JOIN best ON own.site_id = best.site_id AND own.keyword = best.keyword""")
def compared_ranks(spark, sf_dir):
    return _shown(K.compare_ranks(_client(spark, sf_dir)))


@query(f"WITH {I.RANKS} SELECT unnest(['client-0', 'client-1']) AS site_id, keyword, domain, position::INTEGER AS position FROM r WHERE domain NOT IN ('nation_0', 'nation_1') "
       "UNION ALL SELECT 'client-0', keyword, domain, position::INTEGER FROM r WHERE domain = 'nation_1' "
       "UNION ALL SELECT 'client-1', keyword, domain, position::INTEGER FROM r WHERE domain = 'nation_0'")
def competitor_positions(spark, sf_dir):
    return K.compare_ranks(_client(spark, sf_dir)).select(
        "site_id", "keyword", F.explode("competitors_ranking").alias("domain", "position"))


_VOLUME = "vol AS (SELECT p_name || ' ' || lower(p_type) AS keyword, count(*)::INTEGER AS volume FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"


@query(f"""{_PAIRS}, {_VOLUME}
SELECT best.site_id, keyword, volume, rivals AS competitors_ranking, client_position::INTEGER AS client_position, best_rival::INTEGER AS best_rival,
round(volume * (1 / best_rival - coalesce(1 / client_position, 0)), 6) AS gap_score,
CASE WHEN client_position IS NULL THEN 'missing' ELSE 'underperforming' END AS opportunity_type
FROM best LEFT JOIN own USING (site_id, keyword) JOIN vol USING (keyword) WHERE client_position IS NULL OR client_position > best_rival""")
def competitor_gaps(spark, sf_dir):
    gaps = K.gap_analysis(_client(spark, sf_dir), _volumes(spark, sf_dir))
    return _shown(gaps).withColumn("gap_score", F.round("gap_score", 6))


_QUOTA = {"product": 3, "blog": 2, "landing": 2, "service": 1}
_PLAN = f"""{_ROLL}, items AS (SELECT * FROM clu WHERE n_secondary >= 3),
q AS (SELECT *, row_number() OVER (PARTITION BY site_id, content_type_suggestion ORDER BY total_volume DESC, pillar) AS qn FROM items),
wk AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY total_volume DESC, pillar) AS week FROM q
  WHERE qn <= CASE content_type_suggestion {" ".join(f"WHEN '{t}' THEN {n}" for t, n in _QUOTA.items())} ELSE 0 END),
plan AS (SELECT *, ntile(3) OVER (PARTITION BY site_id ORDER BY total_volume DESC, pillar) AS third FROM wk WHERE week <= 5)"""


def _plan(spark, sf_dir):
    k = I.keywords(spark, sf_dir)
    return K.content_calendar(K.cluster_rollup(k), k, _QUOTA, weeks=5)


@query(f"""{_PLAN} SELECT site_id, week::INTEGER AS week, pillar AS topic, content_type_suggestion AS content_type, pillar AS primary_keyword,
secondary AS secondary_keywords, id AS cluster_id, CASE third WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS priority FROM plan""")
def content_calendar(spark, sf_dir):
    return _plan(spark, sf_dir).select(
        "site_id", "week", "topic", "content_type", "primary_keyword",
        F.array_join("secondary_keywords", ",").alias("secondary_keywords"), "cluster_id", "priority")


@query(f"""{_PLAN} SELECT site_id, content_type_suggestion AS content_type, count(*) AS items FROM items WHERE content_type_suggestion IN ('landing', 'service') GROUP BY ALL""")
def unquoted_types(spark, sf_dir):
    """Items whose type a quota without landing and service pages cannot plan."""
    k = I.keywords(spark, sf_dir)
    return K.unquoted_types(K.calendar_items(K.cluster_rollup(k), k), {"product": 3, "blog": 2})


@query(f"""{_PLAN}, types AS (SELECT DISTINCT site_id, unnest(['product', 'blog', 'landing', 'service']) AS content_type, unnest([3, 2, 2, 1]) AS quota FROM plan)
SELECT site_id, content_type, quota, count(id) AS planned FROM types LEFT JOIN plan USING (site_id) WHERE plan.content_type_suggestion = content_type GROUP BY ALL
UNION ALL SELECT site_id, content_type, quota, 0 FROM types ANTI JOIN (SELECT site_id, content_type_suggestion AS content_type FROM plan) USING (site_id, content_type)""")
def content_mix(spark, sf_dir):
    return K.content_mix(_plan(spark, sf_dir), _QUOTA)


@query(f"""WITH {I.CALENDAR}, q AS (SELECT *, row_number() OVER (PARTITION BY site_id, content_type ORDER BY idx) AS qn FROM cal)
SELECT site_id, topic, wk AS week FROM (SELECT site_id, topic, row_number() OVER (PARTITION BY site_id ORDER BY idx)::INTEGER AS wk FROM q
WHERE (content_type = 'blog' AND qn <= 20) OR (content_type = 'service' AND qn <= 10) OR (content_type = 'landing' AND qn <= 4) QUALIFY wk <= 36)""")
def assigned_weeks(spark, sf_dir):
    items = I.calendar(spark, sf_dir).drop("week").withColumn("score", -F.col("idx").cast("double"))
    c = RunConfig()
    return K.assign_weeks(items, c.content_mix, c.calendar_weeks).select("site_id", "topic", "week")


@query(f"""WITH {I.CALENDAR} SELECT site_id, idx, ntile(3) OVER (PARTITION BY site_id ORDER BY priority, idx)::INTEGER AS third FROM cal""")
def priority_thirds(spark, sf_dir):
    """Thirds over whole, unbounded groups."""
    return tiles(I.calendar(spark, sf_dir), ["site_id"], ["priority", "idx"], 3, "third").select("site_id", "idx", "third")


@query(f"WITH {I.DOCS} SELECT site_id, url, row_number() OVER (PARTITION BY site_id ORDER BY crawl_seq)::BIGINT AS idx FROM d")
def numbered_rows(spark, sf_dir):
    return number_rows(I.docs(spark, sf_dir).select("site_id", "crawl_seq", "url"), ["crawl_seq"], range_rows=100).select("site_id", "url", "idx")


def _linked_drafts(spark, sf_dir):
    """Documents as drafts that link to their own page at a sentence's end, to a page named by their length in Markdown, relative, and
    to another host; half of the sources use an inflected US spelling."""
    d = I.docs(spark, sf_dir)
    text = F.concat("text_content", F.lit("\nSee "), "url", F.lit(". Or [this](/"), F.length("text_content").cast("string"),
                    F.lit(") and (https://other.example.net/x). The colors."))
    return d.select("site_id", F.col("crawl_seq").alias("idx"),
                    F.when(F.col("site_id") < "src5", text).otherwise(F.replace(text, F.lit("colors"), F.lit("colours"))).alias("content"))


_DRAFTS = f"""{I.DOCS}, known AS (SELECT site_id, url FROM d),
dl AS (SELECT site_id, crawl_seq AS idx, '/' || length(text_content) AS target, 'https://' || site_id || '.example.com/' || length(text_content) AS url FROM d),
bad AS (SELECT site_id, idx, target FROM dl ANTI JOIN known USING (site_id, url)),
dr AS (SELECT site_id, crawl_seq AS idx, text_content || chr(10) || 'See ' || url || '. Or [this](/' || length(text_content) || ') and (https://other.example.net/x). The ' ||
  CASE WHEN site_id < 'src5' THEN 'colors.' ELSE 'colours.' END AS content FROM d)"""


@query(f"WITH {_DRAFTS} SELECT site_id, idx, target FROM bad")
def broken_links(spark, sf_dir):
    return K.broken_links(K.draft_links(_linked_drafts(spark, sf_dir)), I.docs(spark, sf_dir))


@query(f"""WITH {_DRAFTS},
n AS (SELECT site_id, idx, content, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS words,
  len(regexp_extract_all(content, '[.!?]+')) AS sentences, len(regexp_extract_all(lower(content), '[aeiouy]+')) AS syllables FROM dr)
SELECT n.site_id, n.idx, words AS word_count, round(206.835 - 1.015 * (words / greatest(sentences, 1)) - 84.6 * (syllables / words), 6) AS readability_score,
NOT regexp_matches(content, '(?i)(?:^|[^a-z])(?:{"|".join(K.us_forms())})(?:[^a-z]|$)') AS uk_english_verified, bad.idx IS NULL AS internal_links_validated
FROM n LEFT JOIN bad ON bad.site_id = n.site_id AND bad.idx = n.idx""")
def draft_checks(spark, sf_dir):
    return K.draft_qa(_linked_drafts(spark, sf_dir), I.docs(spark, sf_dir)).withColumn(
        "readability_score", F.round("readability_score", 6)).withColumn("word_count", F.col("word_count").cast("long"))


# The first pairs of words of documents with their document frequency, as terms that nobody has scored yet.
_CHAIN_TERMS = f"""{I.DOCS}, {_TERMS}, k AS (SELECT site_id, term, volume::INTEGER AS volume, 'commercial' AS intent FROM terms WHERE volume >= 3 AND contains(term, ' '))"""


@query(f"""{_components(_CHAIN_TERMS, 0.3)}, c AS (SELECT k.*, cluster_id FROM k JOIN cl USING (site_id, term) WHERE cluster_id IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY site_id, cluster_id ORDER BY volume DESC, term) AS rn FROM c),
roll AS (SELECT site_id, cluster_id, sum(volume)::BIGINT AS total_volume, max(term) FILTER (WHERE rn = 1) AS pillar,
  string_agg(term, ',' ORDER BY rn) FILTER (WHERE rn BETWEEN 2 AND 7) AS secondary_keywords, count(*) FILTER (WHERE rn BETWEEN 2 AND 7) AS n FROM rk GROUP BY 1, 2),
wk AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY total_volume DESC, pillar) AS week FROM roll WHERE n >= 3)
SELECT site_id, week::BIGINT AS idx, pillar AS topic, 'service' AS content_type, secondary_keywords, cluster_id FROM wk WHERE week <= {RunConfig().content_mix["service"]}""")
def keyword_pipeline(spark, sf_dir):
    """From page texts to a calendar: terms, scores, thresholds, clusters, rollup and the default mix."""
    c = RunConfig()
    terms = K.candidate_terms(I.docs(spark, sf_dir)).filter(F.col("term").contains(" ")).select(
        "site_id", "term", F.col("volume").cast("int").alias("volume"), F.lit(0.0).alias("ads_competition"),
        F.lit(50.0).alias("difficulty_proxy"), F.lit("commercial").alias("intent"))
    kept = K.filter_keywords(K.score_keywords(terms), 3, c.max_ads_competition, c.max_difficulty)
    clustered = durable(K.cluster_keywords(durable(kept), 0.3, c.min_cluster_size))
    plan = K.content_calendar(K.cluster_rollup(clustered), clustered, c.content_mix, c.calendar_weeks)
    return plan.select("site_id", "idx", "topic", "content_type", F.array_join("secondary_keywords", ",").alias("secondary_keywords"), "cluster_id")
