"""Facet operators on hand-written pages with the default lexicon."""
import pytest
from pyspark.sql import functions as F

from sitelode.lexicons import WHOLE_WORD_LABELS, Lexicon
from sitelode.operators import facets as X
from sitelode.plans.analysis import analyze_facets, analyze_sites

SCHEMA = "site_id string, crawl_seq long, url string, text_content string"


@pytest.fixture
def page(frame):
    return lambda *texts: frame(SCHEMA, *[("s", i, f"https://s/p{i}", t) for i, t in enumerate(texts)])


def found(df):
    return sorted(r["value"] for r in df.collect())


def test_service_phrases(page):
    df = page("Best web design services in town today. We sell tea.", "Support")
    assert found(X.service_phrases(df)) == ["support", "web design services in town"]


def test_service_phrase_needs_six_characters(page):
    lexicon = Lexicon(service_words=("ab",))
    assert found(X.service_phrases(page("ab yy. long ab word"), lexicon)) == ["long ab word"]


def test_key_pages(frame):
    rows = [("a", i, f"https://a/{'about' if i == 7 else i}", "t") for i in range(9)] + [("b", i, f"https://b/{i}", "t") for i in range(9)]
    got = [tuple(r) for r in X.key_pages(frame(SCHEMA, *rows)).select("site_id", "crawl_seq").collect()]
    assert sorted(got) == [("a", 7)] + [("b", i) for i in range(5)]


def test_headings_and_links(frame):
    df = frame("site_id string, crawl_seq long, url string, headings map<string,array<string>>, internal_links array<string>",
               ("s", 1, "u", {"h2": ["Our Services", "Team"], "h3": ["Solutions"]},
                ["https://s/web-design_support", "https://s/training/", "https://s/x"]))
    assert found(X.heading_services(df)) == ["Our Services"]
    assert found(X.link_services(df)) == ["Web Design Support"]
    assert found(X.link_services(df, n_links=0)) == []


def test_exclusions(page):
    df = page("We do not offer the free delivery, gift cards and refunds. Fine. Not included: setup.")
    assert found(X.exclusions(df)) == ["free delivery", "gift cards", "refunds", "setup"]
    assert found(X.exclusions(df, reference_groups=True)) == ["offer", "setup"]


def test_brand_terms(page, frame):
    df = page("x © 2024 Acme Ltd. All © 2023 Other.", "A™B™ Cool™ Nice® ab®")
    assert found(X.copyright_holders(df)) == ["Acme Ltd"]
    assert found(X.trademark_terms(df)) == ["A™B", "Cool"]
    assert found(X.registered_terms(df)) == ["Nice", "ab"]
    names = frame("site_id string, name string", ("s", "Acme"))
    assert found(X.brand_terms(df, names)) == ["Acme", "Acme Ltd", "A™B", "Cool", "Nice"]


def test_audiences(page):
    df = page("Designed for busy Parents. IDEAL FOR cats. Our hospital helps a mango SME.")
    assert found(X.audience_phrases(df)) == ["busy Parents", "cats"]
    assert found(X.audience_labels(df)) == ["Healthcare", "Non-profit"]
    whole = Lexicon(audience_labels=WHOLE_WORD_LABELS, word_boundary_labels=True)
    assert found(X.audience_labels(df, whole)) == ["Healthcare", "SMB"]
    assert found(X.audiences(df)) == ["Healthcare", "Non-profit", "busy Parents", "cats"]


def test_value_props(page):
    df = page("Unlike our competitors we care. Why choose us for tea. The only shop. The only tea shop in town.")
    assert found(X.value_props(df)) == ["Why choose us for tea", "our competitors", "tea shop in town"]


def test_triggers_and_entities(page, frame):
    df = page("We offer web design and the hosting. Acme is based in New York, USA. Serving Paris since 1990.")
    assert found(X.trigger_services(df)) == ["hosting", "web design"]
    words = frame("term string, label string", ("New York", "GPE"), ("Paris", "LOC"), ("Acme", "ORG"), ("web design", "PRODUCT"))
    assert found(X.trigger_locations(df, words)) == ["New York", "Paris"]
    matches = X.match_entities(df, words)
    assert sorted(r["term"] for r in matches.collect()) == ["Acme", "New York", "Paris", "web design"]
    assert sorted(r["term"] for r in X.match_entities(df, words, head_chars=30).collect()) == ["web design"]
    routed = X.entity_facets(matches, Lexicon(product_words=("design",)))
    assert sorted((r["facet"], r["value"]) for r in routed.collect()) == [
        ("locations", "New York"), ("locations", "Paris"), ("products", "web design"), ("services", "Acme")]


def test_clean_values_bounds(frame):
    df = frame("site_id string, url string, facet string, value string",
               *[("s", "u", "f", v) for v in (" ab ", "abc", "x" * 99, "x" * 100)])
    assert [len(v) for v in found(X.clean_values(df))] == [3, 99]
    once = X.distinct_facets(df)
    assert once.exceptAll(X.distinct_facets(once.withColumn("url", F.lit("u")))).isEmpty()


def test_business_record_holds_every_value(frame):
    facets = frame("site_id string, facet string, value string", *[("big", "services", f"v{i:05d}") for i in range(12_000)],
                   ("small", "products", "p"))
    sites = frame("site_id string, name string, homepage string", ("big", "B", "b"), ("small", "S", "s"), ("none", "N", "n"))
    wide = {r["site_id"]: r for r in X.business_entity(facets, sites).collect()}
    assert len(wide) == 3 and wide["big"]["services"] == [f"v{i:05d}" for i in range(12_000)]
    assert wide["small"]["products"] == ["p"] and wide["none"]["services"] == []


def test_long_places_and_unicode_space(page, frame):
    df = page("Based in United States of America. ©\u00a02024\u2003Acme Ltd. Best\u00a0Widget™ sells at Bank of New York Mellon.")
    words = frame("term string, label string", ("United States of America", "GPE"), ("Bank of New York Mellon", "ORG"))
    assert found(X.trigger_locations(df, words)) == ["United States of America"]
    assert sorted(r["term"] for r in X.match_entities(df, words).collect()) == ["Bank of New York Mellon", "United States of America"]
    assert found(X.copyright_holders(df)) == ["Acme Ltd"] and found(X.trademark_terms(df)) == ["Widget"]


def test_full_analysis(page, frame):
    df = page("Best web design services in town today. Ideal for cats. © 2024 Acme Ltd. Pioneering slow brewed tea. We cannot fly kites.")
    record = analyze_sites(df.withColumn("url", F.lit("https://acme-tea.com/p")), dehyphenate=True).first()
    assert (record["name"], record["homepage"]) == ("Acme Tea", "https://acme-tea.com/")
    assert record["services"] == ["web design services in town"]
    assert record["target_audiences"] == ["cats"]
    assert record["exclusions"] == ["fly kites"]
    assert record["brand_terms"] == ["Acme Ltd", "Acme Tea"]
    assert record["unique_value_props"] == ["slow brewed tea"]
    assert record["industries"] == []
    words = frame("term string, label string", ("town", "GPE"))
    assert ("locations", "town") in {(r["facet"], r["value"]) for r in analyze_facets(df, entity_dict=words).collect()}


def test_tagger_seam(page):
    def tagger(batches):
        for pdf in batches:
            yield pdf[["site_id", "url"]].assign(label="ORG", term=pdf["text_content"].str[:4])

    assert X.tag_with_model(page("Acme x"), tagger).first()["term"] == "Acme"


def test_extraction_is_not_repeated_in_a_filter(page):
    """An inferred size filter would evaluate the whole extraction a second time."""
    for df in (X.service_phrases(page("a")), X.audience_phrases(page("a")), analyze_facets(page("a"))):
        assert "Filter (size(" not in df._jdf.queryExecution().executedPlan().toString()
