"""Facet mining. Texts hold few of the default triggers, so queries pass a lexicon that does occur."""

from pyspark.sql import functions as F

from ..lexicons import AUDIENCE_LABELS, Lexicon, NOUN_STOPWORDS
from ..operators import facets as X, parse as P
from ..operators.ranking import first_pages, top_examples
from ..plans.analysis import analyze_facets
from . import inputs as I
from .registry import query

WORDS = Lexicon(
    key_page_terms=("/de/",), service_words=("worthless", "stupid", "tion"), heading_words=("tion", "stupid"),
    link_words=("s-1", "s-5"), exclusion_patterns=("for (the|a)", "with", "the only"),
    audience_patterns=("for ([^.]+)", "with ([^.]+)"),
    audience_labels=AUDIENCE_LABELS + (("Rude", ("stupid", "idiot")),),
    value_patterns=("the only ([^.]+)", "of the", "from ([^.]+)"),
    service_triggers=("of the",), location_triggers=("of the", "in"), product_words=("tion",))

_STOP = "|".join(NOUN_STOPWORDS)
_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"


def _contexts(source: str) -> str:
    """Service phrases of rows ``site_id, url, text_content``."""
    any_word = " OR ".join(f"contains(ws[i], '{w}')" for w in WORDS.service_words)
    return f"""SELECT site_id, url, array_to_string(ws[greatest(1, i - 2):least(len(ws), i + 2)], ' ') AS value FROM (
  SELECT site_id, url, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT site_id, url, {_WORDS.format('s')} AS ws FROM (
  SELECT site_id, url, unnest(string_split(lower(text_content), '.')) AS s FROM {source})))
  WHERE ({any_word}) AND length(array_to_string(ws[greatest(1, i - 2):least(len(ws), i + 2)], ' ')) > 5"""


def _nouns(fragments: str) -> str:
    """Noun phrases of rows ``site_id, url, m``."""
    return f"""SELECT site_id, url, value FROM (SELECT site_id, url,
  regexp_replace(regexp_replace(trim(piece), '^((?:{_STOP})( +|$))+', ''), '((?:^| +)(?:{_STOP}))+$', '') AS value FROM (
  SELECT site_id, url, unnest(regexp_split_to_array(trim(regexp_replace(m, '\\s+', ' ', 'g')), ' ?[,;:()!?] ?| and | or ')) AS piece FROM ({fragments})))
  WHERE value <> '' AND len(string_split(value, ' ')) <= 4"""


def _excluded(source: str) -> str:
    return _nouns(" UNION ALL ".join(
        f"SELECT site_id, url, regexp_replace(unnest(regexp_extract_all(lower(text_content), '{p}[^.]*')), '^(?:{p})', '') AS m FROM {source}"
        for p in WORDS.exclusion_patterns))


def _phrases(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT site_id, url, unnest(regexp_extract_all(text_content, '(?i){p}', 1)) AS value FROM {source}"
        for p in WORDS.audience_patterns)


def _labels(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT site_id, url, '{label}' AS value FROM {source} WHERE " +
        " OR ".join(f"contains(lower(text_content), '{t}')" for t in terms) for label, terms in WORDS.audience_labels)


def _props(source: str) -> str:
    return "SELECT site_id, url, trim(value) AS value FROM (" + " UNION ALL ".join(
        f"SELECT site_id, url, unnest(regexp_extract_all(text_content, '(?i){p}[^.]*', {1 if '(' in p else 0})) AS value FROM {source}"
        for p in WORDS.value_patterns) + ") WHERE length(value) > 10 AND length(value) < 200"


def _triggered(source: str) -> str:
    return _nouns(" UNION ALL ".join(
        f"SELECT site_id, url, unnest(regexp_extract_all(lower(text_content), '(?:^|[^\\pL\\pN_]){p}\\s+([^.;]+)', 1)) AS m FROM {source}"
        for p in WORDS.service_triggers))


_KEY = f"""{I.LANG_DOCS}, key_docs AS (SELECT * FROM g WHERE contains(url, '/de/')
  UNION ALL SELECT * FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY crawl_seq) <= 5)
  WHERE site_id NOT IN (SELECT site_id FROM g WHERE contains(url, '/de/')))"""
_HEAD = """head AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY crawl_seq) <= 10)"""


def _rows(df):
    return df.select("site_id", "url", "facet", "value")


@query(f"WITH {_KEY} SELECT site_id, url FROM key_docs")
def key_pages(spark, sf_dir):
    return X.key_pages(I.lang_docs(spark, sf_dir), WORDS.key_page_terms).select("site_id", "url")


@query(f"WITH {I.TEXTS} SELECT site_id, url FROM t QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY crawl_seq) <= 5")
def key_pages_by_default_terms(spark, sf_dir):
    return X.key_pages(I.pages(spark, sf_dir)).select("site_id", "url")


@query(f"WITH {_KEY} SELECT site_id, url, 'services' AS facet, value FROM ({_contexts('key_docs')})")
def service_phrases(spark, sf_dir):
    return _rows(X.service_phrases(I.lang_docs(spark, sf_dir), WORDS))


@query(f"""WITH {I.DOC_LINES}, ten AS (SELECT crawl_seq FROM h QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY crawl_seq) <= 10)
SELECT site_id, url, 'services' AS facet, line AS value FROM l SEMI JOIN ten USING (crawl_seq)
WHERE i % 4 = 0 AND (contains(lower(line), 'tion') OR contains(lower(line), 'stupid'))""")
def heading_services(spark, sf_dir):
    parsed = P.parse_pages(first_pages(I.doc_html(spark, sf_dir), 10))
    return _rows(X.heading_services(parsed, WORDS))


@query(f"""WITH {I.DOC_LINES}, ten AS (SELECT crawl_seq FROM h QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY crawl_seq) <= 10)
SELECT site_id, url, 'services' AS facet, 'S ' || i || '?A=1&B=2' AS value FROM l SEMI JOIN ten USING (crawl_seq)
WHERE i % 4 = 1 AND i // 4 < 5 AND (starts_with('s-' || i, 's-1') OR starts_with('s-' || i, 's-5'))""")
def link_services(spark, sf_dir):
    parsed = P.parse_pages(first_pages(I.doc_html(spark, sf_dir), 10))
    return _rows(X.link_services(parsed, WORDS, n_links=5))


@query(f"WITH {I.DOCS} SELECT site_id, url, 'exclusions' AS facet, value FROM ({_excluded('d')})")
def exclusions(spark, sf_dir):
    return _rows(X.exclusions(I.docs(spark, sf_dir), WORDS))


def _marked(spark, sf_dir):
    """Documents with a copyright line and trade marks after common endings."""
    text = F.replace(F.replace(F.col("text_content"), F.lit("tion "), F.lit("tion™ ")), F.lit("ing "), F.lit("ing® "))
    return I.docs(spark, sf_dir).withColumn("text_content", F.concat(F.lit("x ©\u00a0 2024\u2003\n"), text))


_MARKED = f"""{I.DOCS}, m AS (SELECT site_id, url, 'x ©' || chr(160) || ' 2024' || chr(8195) || chr(10) || replace(replace(text_content, 'tion ', 'tion™ '), 'ing ', 'ing® ') AS text_content FROM d)"""
_HOLDER = "SELECT site_id, url, trim(regexp_extract(text_content, '©[\\s\\pZ]*\\d{4}[\\s\\pZ]*([^.]+)', 1)) AS value FROM m"
_TM = "SELECT site_id, url, unnest(regexp_extract_all(text_content, '([^\\s]+)™', 1)) AS value FROM m"
_REG = "SELECT site_id, url, unnest(regexp_extract_all(text_content, '([^\\s]+)®', 1)) AS value FROM m"


@query(f"WITH {_MARKED} SELECT site_id, url, 'brand_terms' AS facet, value FROM ({_HOLDER}) WHERE value <> ''")
def copyright_holders(spark, sf_dir):
    return _rows(X.copyright_holders(_marked(spark, sf_dir)))


@query(f"WITH {_MARKED} SELECT site_id, url, 'brand_terms' AS facet, value FROM ({_TM})")
def trademark_terms(spark, sf_dir):
    return _rows(X.trademark_terms(_marked(spark, sf_dir)))


@query(f"WITH {_MARKED} SELECT site_id, url, 'brand_terms' AS facet, value FROM ({_REG})")
def registered_terms(spark, sf_dir):
    return _rows(X.registered_terms(_marked(spark, sf_dir)))


@query(f"""WITH {_MARKED} SELECT DISTINCT site_id, 'brand_terms' AS facet, trim(value) AS value FROM ({_HOLDER} UNION ALL {_TM} UNION ALL {_REG})
WHERE length(value) > 2 UNION SELECT DISTINCT site_id, 'brand_terms', upper(site_id[1]) || site_id[2:] FROM d""")
def brand_terms(spark, sf_dir):
    pages = _marked(spark, sf_dir)
    return X.brand_terms(pages, X.site_names(pages))


@query(f"WITH {I.DOCS} SELECT site_id, url, 'target_audiences' AS facet, value FROM ({_phrases('d')})")
def audience_phrases(spark, sf_dir):
    return _rows(X.audience_phrases(I.docs(spark, sf_dir), WORDS))


@query(f"WITH {I.DOCS} SELECT DISTINCT site_id, 'target_audiences' AS facet, value FROM ({_labels('d')})")
def audience_labels(spark, sf_dir):
    return X.audience_labels(I.docs(spark, sf_dir), WORDS)


@query(f"WITH {I.DOCS} SELECT DISTINCT site_id, 'target_audiences' AS facet, value FROM ({_phrases('d')} UNION ALL {_labels('d')})")
def audiences(spark, sf_dir):
    return X.audiences(I.docs(spark, sf_dir), WORDS)


@query(f"WITH {I.DOCS} SELECT DISTINCT site_id, 'target_audiences' AS facet, value FROM ({_phrases('d')} UNION ALL {_labels('d')})")
def audience_union(spark, sf_dir):
    d = I.docs(spark, sf_dir)
    return X.union_audiences(X.audience_phrases(d, WORDS), X.audience_labels(d, WORDS))


@query(f"WITH {I.DOCS}, {_HEAD} SELECT site_id, url, 'unique_value_props' AS facet, value FROM ({_props('head')})")
def value_props(spark, sf_dir):
    return _rows(X.value_props(I.docs(spark, sf_dir), WORDS))


@query(f"WITH {I.DOCS} SELECT site_id, url, 'services' AS facet, value FROM ({_triggered('d')})")
def trigger_services(spark, sf_dir):
    return _rows(X.trigger_services(I.docs(spark, sf_dir), WORDS))


@query(f"""WITH {I.DOCS} SELECT DISTINCT site_id, 'services' AS facet, value FROM ({_triggered('d')} UNION ALL {_contexts('d')})""")
def services_union(spark, sf_dir):
    d = I.docs(spark, sf_dir)
    return X.union_services(X.trigger_services(d, WORDS), X.service_phrases(d, WORDS, all_pages=True))


def entity_dict(spark, sf_dir):
    """Words, word pairs and runs of five words of the benchmark texts as an entity dictionary, labelled by length."""
    from ..functions import text as T

    terms = I.table(spark, sf_dir, "benchmark").select(T.plain_tokens("text").alias("t")).select(
        F.explode(T.ngrams(F.col("t"), lengths=(1, 2, 5))).alias("term")).filter(F.length("term") > 6).distinct()
    labels = F.array(*[F.lit(x) for x in ("ORG", "PRODUCT", "GPE", "LOC")])
    return terms.select("term", F.element_at(labels, F.length("term") % 4 + 1).alias("label"))


_TOKENS = "list_filter([regexp_replace(w, '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g') for w in regexp_split_to_array(lower({0}), '\\s+')], lambda w: w <> '')"
_DICT = f"""bw AS (SELECT {_TOKENS.format('text')} AS t FROM benchmark), bi AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM bw),
dict AS (SELECT DISTINCT term, (['ORG', 'PRODUCT', 'GPE', 'LOC'])[length(term) % 4 + 1] AS label FROM (
  SELECT t[i] AS term FROM bi UNION ALL SELECT t[i] || ' ' || t[i + 1] FROM bi WHERE i < len(t) UNION ALL SELECT array_to_string(t[i:i + 4], ' ') FROM bi WHERE i + 4 <= len(t)) WHERE length(term) > 6)"""
_GRAMS = f"""dw AS (SELECT site_id, url, {_TOKENS.format('text_content')} AS t FROM {{0}}), di AS (SELECT site_id, url, t, unnest(range(1, len(t) + 1)) AS i FROM dw),
grams AS (SELECT DISTINCT site_id, url, unnest([array_to_string(t[i:i + n - 1], ' ') for n in [1, 2, 5] if i + n - 1 <= len(t)]) AS term FROM di)"""


@query(f"WITH {I.DOCS}, {_DICT}, {_GRAMS.format('d')} SELECT site_id, url, label, term FROM grams JOIN dict USING (term)")
def entity_matches(spark, sf_dir):
    return X.match_entities(I.docs(spark, sf_dir), entity_dict(spark, sf_dir))


@query(f"""WITH {I.DOCS}, {_DICT}, {_GRAMS.format('d')} SELECT site_id, url, CASE WHEN label IN ('GPE', 'LOC') THEN 'locations'
  WHEN contains(term, 'tion') THEN 'products' ELSE 'services' END AS facet, term AS value FROM grams JOIN dict USING (term)""")
def entity_facets(spark, sf_dir):
    return X.entity_facets(X.match_entities(I.docs(spark, sf_dir), entity_dict(spark, sf_dir)), WORDS)


_PLACES = f"""pm AS (SELECT site_id, url, {_TOKENS.format('m')} AS t0, [regexp_replace(w, '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g') for w in {_WORDS.format('m')}] AS t FROM (""" + \
    " UNION ALL ".join(
        f"SELECT site_id, url, unnest(regexp_extract_all(lower(text_content), '(?:^|[^\\pL\\pN_]){p}\\s+([^.;,]+)', 1)) AS m FROM d"
        for p in WORDS.location_triggers) + """)),
heads AS (SELECT DISTINCT site_id, url, unnest([array_to_string(t[1:n], ' ') for n in [1, 2, 5] if n <= len(t)]) AS term FROM pm)"""


@query(f"""WITH {I.DOCS}, {_DICT}, {_PLACES} SELECT site_id, url, 'locations' AS facet, term AS value FROM heads JOIN dict USING (term)
WHERE label IN ('GPE', 'LOC')""")
def trigger_locations(spark, sf_dir):
    return _rows(X.trigger_locations(I.docs(spark, sf_dir), entity_dict(spark, sf_dir), WORDS))


@query(f"""WITH {I.DOCS} SELECT site_id, url, 'target_audiences' AS facet, trim(value) AS value FROM ({_phrases('d')})
WHERE length(trim(value)) > 2 AND length(trim(value)) < 100""")
def clean_audiences(spark, sf_dir):
    return _rows(X.clean_values(X.audience_phrases(I.docs(spark, sf_dir), WORDS)))


@query(f"WITH {I.DOCS} SELECT DISTINCT site_id, 'exclusions' AS facet, value FROM ({_excluded('d')})")
def distinct_exclusions(spark, sf_dir):
    return X.distinct_facets(X.exclusions(I.docs(spark, sf_dir), WORDS))


@query(f"""WITH {I.DOCS}, v AS (SELECT DISTINCT site_id, 's' AS f, value FROM ({_triggered('d')}) UNION ALL
  SELECT DISTINCT site_id, 'a', value FROM ({_labels('d')}))
SELECT site_id, count(*) FILTER (WHERE f = 's') AS services, 0::BIGINT AS products, 0::BIGINT AS locations,
  count(*) FILTER (WHERE f = 'a') AS target_audiences, 0::BIGINT AS brand_terms FROM v GROUP BY site_id""")
def facet_counts(spark, sf_dir):
    d = I.docs(spark, sf_dir)
    return X.facet_counts(X.trigger_services(d, WORDS).select("site_id", "facet", "value").unionByName(
        X.audience_labels(d, WORDS)))


@query(f"""WITH {I.DOCS}, v AS (SELECT DISTINCT site_id, 'services' AS facet, value FROM ({_triggered('d')}))
SELECT site_id, facet, value, row_number() OVER (PARTITION BY site_id, facet ORDER BY value)::INTEGER AS rank FROM v QUALIFY rank <= 5""")
def top_service_examples(spark, sf_dir):
    return top_examples(X.trigger_services(I.docs(spark, sf_dir), WORDS), 5)


_ALL = f"""{_KEY}, head AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY crawl_seq) <= 10), v AS (
  SELECT site_id, 'services' AS facet, value FROM ({_contexts('key_docs')}) UNION ALL
  SELECT site_id, 'services', value FROM ({_triggered('key_docs')}) UNION ALL
  SELECT site_id, 'exclusions', value FROM ({_excluded('g')}) UNION ALL
  SELECT site_id, 'target_audiences', value FROM ({_phrases('g')} UNION ALL {_labels('g')}) UNION ALL
  SELECT site_id, 'unique_value_props', value FROM ({_props('head')}) UNION ALL
  SELECT site_id, 'brand_terms', upper(source[1]) || source[2:] FROM (SELECT DISTINCT site_id, split_part(site_id, '-', 1) AS source FROM g)),
clean AS (SELECT DISTINCT site_id, facet, trim(value) AS value FROM v WHERE length(trim(value)) > 2 AND length(trim(value)) < 100)"""


@query(f"WITH {_ALL} SELECT site_id, facet, value FROM clean")
def site_analysis(spark, sf_dir):
    """All facets of all sites in two passes over the text."""
    pages = I.lang_docs(spark, sf_dir)
    return analyze_facets(pages, WORDS, names=X.site_names(pages))


@query(f"""WITH {_ALL} SELECT site_id, upper(split_part(site_id, '-', 1)[1]) || split_part(site_id, '-', 1)[2:] AS name,
  'https://' || split_part(site_id, '-', 1) || '.example.com/' AS homepage, facet, value FROM clean""")
def business_records(spark, sf_dir):
    """Wide business records, unfolded again to one row per value."""
    from ..plans.analysis import analyze_sites
    from ..schema import FACETS

    wide = analyze_sites(I.lang_docs(spark, sf_dir), WORDS)
    arrays = [F.struct(F.lit(f).alias("facet"), F.col(f).alias("items")) for f in FACETS]
    return wide.select("site_id", "name", "homepage", F.explode(F.array(*arrays)).alias("x")).select(
        "site_id", "name", "homepage", F.col("x.facet").alias("facet"), F.explode("x.items").alias("value"))
