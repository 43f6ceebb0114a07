"""Lexicon-driven mining of business facets.

Value extraction is written as array expressions over one page row, so a full analysis reads each
page's text once; DataFrame operators explode those arrays into ``site_id, url, facet, value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.urls import last_segment_phrase, url_part
from ..lexicons import DEFAULT, Lexicon, group_count
from ..session import durable
from .grams import known_grams, normal_term
from .ranking import first_pages

_NO_VALUES = "array<string>"


def _none() -> Column:
    return F.array().cast(_NO_VALUES)


def _all(arrays: Sequence[Column]) -> Column:
    arrays = list(arrays)
    return F.concat(*arrays) if arrays else _none()


def _matches(text: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), _none())


def explode_facet(df: DataFrame, facet: str, values: Column, site_col: str = "site_id") -> DataFrame:
    """One row per value of an array expression."""
    # The expression goes straight into explode: on a plain column Spark would infer a size filter from
    # it and evaluate the whole extraction again in that filter.
    return df.select(F.col(site_col).alias("site_id"), "url", F.lit(facet).alias("facet"),
                     F.explode(values).alias("value"))


# --- value expressions over one page -------------------------------------------------------------

def service_phrase_values(text, lexicon: Lexicon = DEFAULT, min_length: int = 6) -> Column:
    """Words around each service word of each sentence (two before, two after), longer than 5 characters."""
    sentences = F.filter(F.split(F.lower(text), r"\."), lambda s: T.contains_any(s, lexicon.service_words))

    def contexts(sentence: Column) -> Column:
        tokens = T.words(sentence)
        marked = F.transform(tokens, lambda word, i: F.when(
            T.contains_any(word, lexicon.service_words), T.context_window(tokens, i + 1)))
        return F.filter(marked, lambda c: c.isNotNull() & (F.length(c) >= min_length))

    return F.flatten(F.transform(sentences, contexts))


def noun_phrases(fragment: Column, stopwords: Sequence[str], max_words: int = 4) -> Column:
    """Phrases of a lower-case fragment: split at commas, "and", "or"; stop words trimmed; 1-4 words.

    An approximation of noun chunks: no part-of-speech tagging takes place.
    """
    pieces = F.split(T.collapse_space(fragment), r" ?[,;:()!?] ?| and | or ")
    trimmed = F.transform(pieces, lambda p: T.strip_stopwords(F.trim(p), stopwords))
    return F.filter(trimmed, lambda p: (p != "") & (F.size(F.split(p, " ")) <= max_words))


def exclusion_values(text, lexicon: Lexicon = DEFAULT, reference_groups: bool = False, max_words: int = 4) -> Column:
    """Noun phrases of what a page says is not offered; a statement runs to the next full stop.

    ``reference_groups=True`` keeps a pattern's own group instead of what follows it.
    """
    def statements(lowered: Column, pattern: str) -> Column:
        if reference_groups and group_count(pattern):
            return _matches(lowered, f"{pattern}[^.]*", 1)
        return F.transform(_matches(lowered, f"{pattern}[^.]*", 0),
                           lambda m: F.regexp_replace(m, f"^(?:{pattern})", ""))

    found = T.let(F.lower(text), lambda low: _all(statements(low, p) for p in lexicon.exclusion_patterns))
    return F.flatten(F.transform(found, lambda m: noun_phrases(m, lexicon.noun_stopwords, max_words)))


# The patterns of copyright, trademark and registered terms, with Unicode white space.
def copyright_values(text) -> Column:
    """Holder of the first copyright notice of the page."""
    holder = T.trim_space(F.regexp_extract(text, r"(?U)©\s*\d{4}\s*([^.]+)", 1))
    return F.when(holder != "", F.array(holder)).otherwise(_none())


def _before_sign(text, sign: str) -> Column:
    """Non-space runs before ``sign``. Most pages hold none, so the pattern only runs where it occurs."""
    return F.when(F.contains(text, F.lit(sign)), _matches(text, rf"(?U)([^\s]+){sign}", 1)).otherwise(_none())


def trademark_values(text) -> Column:
    """Terms marked with the trademark sign; of ``A™B™`` the longest run, ``A™B``."""
    return _before_sign(text, "™")


def registered_values(text) -> Column:
    """Terms marked as registered."""
    return _before_sign(text, "®")


def audience_phrase_values(text, lexicon: Lexicon = DEFAULT) -> Column:
    """Group 1 of each audience pattern, any case."""
    return _all(_matches(text, f"(?iu){p}", 1) for p in lexicon.audience_patterns)


def audience_label_values(text, lexicon: Lexicon = DEFAULT) -> Column:
    """Labels whose keywords occur in the lower-cased text; substrings unless ``word_boundary_labels``."""
    def hit(terms: Sequence[str]) -> str:
        if lexicon.word_boundary_labels:
            whole = r"(?U)\b(?:" + "|".join(t.lower() for t in terms) + r")\b"
            return f"low rlike {T.sql_literal(whole)}"
        return " or ".join(f"contains(low, {T.sql_literal(t.lower())})" for t in terms)

    labels = ", ".join(f"if({hit(terms)}, {T.sql_literal(label)}, null)" for label, terms in lexicon.audience_labels)
    return T.apply_sql(F.lower(text), "low", f"array_compact(array({labels}))")


def value_prop_values(text, lexicon: Lexicon = DEFAULT, low: int = 11, high: int = 199) -> Column:
    """Value propositions; the length test comes before trimming."""
    found = _all(_matches(text, f"(?iu){p}[^.]*", min(group_count(p), 1)) for p in lexicon.value_patterns)
    return F.transform(F.filter(found, lambda v: F.length(v).between(low, high)), T.trim_space)


def trigger_service_values(text, lexicon: Lexicon = DEFAULT, max_words: int = 4) -> Column:
    """Noun phrases after a service trigger, up to the end of the clause."""
    found = T.let(F.lower(text), lambda low: _all(
        _matches(low, rf"(?U)\b{p}\s+([^.;]+)", 1) for p in lexicon.service_triggers))
    return F.flatten(F.transform(found, lambda m: noun_phrases(m, lexicon.noun_stopwords, max_words)))


def trigger_location_phrases(text, lexicon: Lexicon = DEFAULT) -> Column:
    """What follows a location trigger up to the next stop, as lower-case words without edge punctuation."""
    found = T.let(F.lower(text), lambda low: _all(
        _matches(low, rf"(?U)\b(?:{p})\s+([^.;,]+)", 1) for p in lexicon.location_triggers))
    return F.transform(F.filter(found, lambda m: F.trim(m) != ""), lambda m: F.transform(T.words(m), T.strip_punctuation))


def heading_service_values(h2, lexicon: Lexicon = DEFAULT) -> Column:
    """h2 headings that name a service."""
    return F.coalesce(F.filter(h2, lambda h: T.contains_any(h, lexicon.heading_words)), _none())


def link_service_values(links, lexicon: Lexicon = DEFAULT, n_links: int = 50) -> Column:
    """Last-segment phrases of service links among the page's first ``n_links`` internal links."""
    first = F.slice(links, F.lit(1), F.lit(n_links))
    phrases = F.transform(F.filter(first, lambda u: T.contains_any(u, lexicon.link_words)), last_segment_phrase)
    return F.coalesce(F.array_compact(phrases), _none())


# --- page filters --------------------------------------------------------------------------------

def is_key_page(url, terms: Sequence[str] = DEFAULT.key_page_terms) -> Column:
    return T.contains_any(url, terms)


def key_pages(df: DataFrame, terms: Sequence[str] = DEFAULT.key_page_terms, fallback_n: int = 5) -> DataFrame:
    """Pages whose URL names them as key pages; a site without any gives its first ``fallback_n`` pages.

    No window ranges over a whole site's text: the fallback takes the per-site head (cut before the
    shuffle) and drops sites that have a key page, which are found from the URL column alone.
    """
    marked = is_key_page("url", terms)
    named = df.filter(marked)
    sites = df.select("site_id", "url").filter(marked).select("site_id").distinct()
    return named.unionByName(first_pages(df, fallback_n).join(sites, "site_id", "left_anti").select(*df.columns))


# --- facet operators -----------------------------------------------------------------------------

def service_phrases(pages: DataFrame, lexicon: Lexicon = DEFAULT, all_pages: bool = False) -> DataFrame:
    """Service phrases of key pages."""
    source = pages if all_pages else key_pages(pages.select("site_id", "crawl_seq", "url", "text_content"),
                                               lexicon.key_page_terms)
    return explode_facet(source, "services", service_phrase_values(F.col("text_content"), lexicon))


def heading_services(pages: DataFrame, lexicon: Lexicon = DEFAULT, n_pages: int = 10) -> DataFrame:
    """Services named by the h2 headings (``headings`` map) of each site's first pages."""
    head = first_pages(pages.select("site_id", "crawl_seq", "url", "headings"), n_pages)
    return explode_facet(head, "services", heading_service_values(
        F.try_element_at("headings", F.lit("h2")), lexicon))


def link_services(pages: DataFrame, lexicon: Lexicon = DEFAULT, n_pages: int = 10, n_links: int = 50) -> DataFrame:
    """Services named by the first ``internal_links`` of each site's first pages."""
    head = first_pages(pages.select("site_id", "crawl_seq", "url", "internal_links"), n_pages)
    return explode_facet(head, "services", link_service_values(F.col("internal_links"), lexicon, n_links))


def exclusions(pages: DataFrame, lexicon: Lexicon = DEFAULT, reference_groups: bool = False,
               max_words: int = 4) -> DataFrame:
    """Exclusions; ``max_words`` is the longest noun phrase that is one, by the data model four."""
    return explode_facet(pages, "exclusions",
                         exclusion_values(F.col("text_content"), lexicon, reference_groups, max_words))


def copyright_holders(pages: DataFrame) -> DataFrame:
    return explode_facet(pages, "brand_terms", copyright_values(F.col("text_content")))


def trademark_terms(pages: DataFrame) -> DataFrame:
    return explode_facet(pages, "brand_terms", trademark_values(F.col("text_content")))


def registered_terms(pages: DataFrame) -> DataFrame:
    return explode_facet(pages, "brand_terms", registered_values(F.col("text_content")))


def _long_enough(values: Column, longer_than: int = 2) -> Column:
    """Length test on the raw value, then trimmed."""
    return F.transform(F.filter(values, lambda v: F.length(v) > longer_than), T.trim_space)


def brand_terms(pages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Business name, copyright holders, trademarks and registered terms; distinct per site.

    ``names`` (``site_id, name``) adds the business names.
    """
    text = F.col("text_content")
    marks = _long_enough(F.concat(copyright_values(text), trademark_values(text), registered_values(text)))
    found = explode_facet(pages, "brand_terms", marks).select("site_id", "facet", "value")
    if names is not None:
        found = found.unionByName(
            names.filter(F.length("name") > 2)
            .select("site_id", F.lit("brand_terms").alias("facet"), T.trim_space("name").alias("value")))
    return found.distinct()


def audience_phrases(pages: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    return explode_facet(pages, "target_audiences", audience_phrase_values(F.col("text_content"), lexicon))


def audience_labels(pages: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Audience labels, once per site: one pass, each site's labels merged before the shuffle."""
    found = explode_facet(pages, "target_audiences", audience_label_values(F.col("text_content"), lexicon))
    return found.select("site_id", "facet", "value").distinct()


def audiences(pages: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Phrases and labels together, distinct per site; both come from one pass over the text."""
    text = F.col("text_content")
    both = F.concat(audience_phrase_values(text, lexicon), audience_label_values(text, lexicon))
    return explode_facet(pages, "target_audiences", both).select("site_id", "facet", "value").distinct()


def union_services(a: DataFrame, b: DataFrame) -> DataFrame:
    """Page-derived and navigation-derived services, distinct per site."""
    keep = ("site_id", "facet", "value")
    return a.select(*keep).unionByName(b.select(*keep)).distinct()


union_audiences = union_services


def value_props(pages: DataFrame, lexicon: Lexicon = DEFAULT, n_pages: int = 10) -> DataFrame:
    """Value propositions of each site's first pages."""
    head = first_pages(pages.select("site_id", "crawl_seq", "url", "text_content"), n_pages)
    return explode_facet(head, "unique_value_props", value_prop_values(F.col("text_content"), lexicon))


def trigger_services(pages: DataFrame, lexicon: Lexicon = DEFAULT, max_words: int = 4) -> DataFrame:
    """Noun phrases of up to ``max_words`` words after a service trigger."""
    return explode_facet(pages, "services", trigger_service_values(F.col("text_content"), lexicon, max_words))


def _dictionary(entity_dict: DataFrame) -> DataFrame:
    terms = entity_dict.select(normal_term("term").alias("_term"), "term", "label")
    return terms.filter(F.col("_term") != "").distinct()


def trigger_locations(pages: DataFrame, entity_dict: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Places of the dictionary named right after a location trigger, each once per page, of as many words as its places have.

    The first word after the trigger tells which numbers of words are tried, so phrases that begin no place go first.
    """
    places = _dictionary(entity_dict.filter(F.col("label").isin("GPE", "LOC"))).select("_term", "term")
    words = F.split("_term", " ")
    lengths = places.groupBy(F.get(words, F.lit(0)).alias("_first")).agg(F.collect_set(F.size(words)).alias("_lengths"))
    heads = explode_facet(pages, "locations", F.array_distinct(trigger_location_phrases(F.col("text_content"), lexicon))).join(
        lengths, F.get("value", F.lit(0)) == F.col("_first"))
    tried = F.transform(F.filter("_lengths", lambda n: n <= F.size("value")),
                        lambda n: F.array_join(F.slice("value", F.lit(1), n), " "))
    return heads.select("site_id", "url", "facet", F.explode(tried).alias("_term")).join(places, "_term").select(
        "site_id", "url", "facet", F.col("term").alias("value")).distinct()


def match_entities(pages: DataFrame, entity_dict: DataFrame, head_chars: int | None = None) -> DataFrame:
    """Dictionary terms found in each page, of any number of words: ``site_id, url, label, term``.

    Each page is reduced to the n-grams around words under which the dictionary files its terms before the equi-join. Both sides
    are lower-case words without edge punctuation. Whole texts are searched; ``head_chars=5000`` limits
    the search to the head of each page.
    """
    text = F.col("text_content") if head_chars is None else T.head_text("text_content", head_chars)
    terms = durable(_dictionary(entity_dict))
    grams = known_grams(pages.select("site_id", "url", T.plain_tokens(text).alias("_tokens")), "_tokens", terms, "_term")
    return grams.join(terms, "_term").select("site_id", "url", "label", "term")


def tag_with_model(pages: DataFrame, tagger, schema: str = "site_id string, url string, label string, term string",
                   ) -> DataFrame:
    """Seam for a user-supplied tagger: ``tagger`` maps an iterator of pandas batches of pages."""
    return pages.select("site_id", "url", "text_content").mapInPandas(tagger, schema)


def entity_facets(matches: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Route entities: places to locations, product-like names to products, other names to services."""
    facet = (
        F.when(F.col("label").isin("GPE", "LOC"), "locations")
        .when(F.col("label").isin("ORG", "PRODUCT"),
              F.when(T.contains_any("term", lexicon.product_words), "products").otherwise("services"))
    )
    return matches.select("site_id", "url", facet.alias("facet"), F.col("term").alias("value")).filter(
        F.col("facet").isNotNull())


# --- cleaning and aggregation --------------------------------------------------------------------

def clean_values(facets: DataFrame, lo: int = 3, hi: int = 99) -> DataFrame:
    """Trim values and keep those of ``lo`` to ``hi`` characters."""
    return facets.withColumn("value", T.trim_space("value")).filter(F.length("value").between(lo, hi))


def distinct_facets(facets: DataFrame) -> DataFrame:
    """One row per site, facet and value; duplicates merge before the shuffle."""
    return facets.select("site_id", "facet", "value").distinct()


def facet_counts(facets: DataFrame,
                 names: Sequence[str] = ("services", "products", "locations", "target_audiences", "brand_terms"),
                 ) -> DataFrame:
    """Distinct values per facet as columns, 0 where a site has none."""
    return distinct_facets(facets).groupBy("site_id").agg(*[
        F.count(F.when(F.col("facet") == name, F.lit(1))).alias(name) for name in names])


def business_entity(facets: DataFrame, sites: DataFrame) -> DataFrame:
    """Wide business record, one row per site, with sorted facet arrays; ``sites`` has ``site_id, name, homepage``.

    The long form (:func:`distinct_facets`) is the primary result: this row gathers all values of a site, as the record of
    the data model does, so use the long form for sites with more values than fit one row.
    """
    from ..schema import FACETS

    arrays = distinct_facets(facets).groupBy("site_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("facet") == f, F.col("value")))).alias(f) for f in FACETS
    ])
    return sites.join(arrays, "site_id", "left").select(
        "site_id", "name", "homepage", *[F.coalesce(F.col(f), _none()).alias(f) for f in FACETS])


def site_names(pages: DataFrame, dehyphenate: bool = False) -> DataFrame:
    """``site_id, name, homepage`` from each site's first page."""
    from ..functions.urls import business_name, url_root

    first = pages.groupBy("site_id").agg(F.min_by("url", F.struct("crawl_seq", "url")).alias("_url"))
    root = url_root("_url")
    return first.select("site_id", business_name(root, dehyphenate).alias("name"),
                        F.concat(root, F.lit("/")).alias("homepage"))
