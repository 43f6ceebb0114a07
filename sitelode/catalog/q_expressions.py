"""Scalar expressions over whole tables."""

from pyspark.sql import functions as F

from ..functions import text as T, urls as U
from . import inputs as I
from .registry import query


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS authority,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query,
  regexp_extract(url, '#(.*)$', 1) AS ref FROM pages""")
def url_parts(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select(
        "page_id", *[U.url_part("url", p).alias(a) for p, a in (
            ("PROTOCOL", "scheme"), ("AUTHORITY", "authority"), ("PATH", "path"), ("QUERY", "query"), ("REF", "ref"))])


# Reference forms resolved against every page URL.
_REFS = ("../c", "?y=2", "#z", "//o.com/z", "/../b/./c", "mailto:x@y", "", "g//h/", "./", "https://o.com/a")


@query("""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS root, regexp_extract(url, '^[a-z]+:', 0) AS scheme,
  regexp_extract(url, '^[^?#]*', 0) AS plain, regexp_extract(url, '[?][^#]*', 0) AS query,
  root || regexp_extract(url, '^[a-z]+://[^/?#]*(/([^?#]*/)?)', 1) AS folder FROM pages)
SELECT page_id, '../c' AS ref, CASE WHEN folder = root || '/' THEN root || '/c' ELSE regexp_replace(folder, '[^/]+/$', 'c') END AS target FROM u
UNION ALL SELECT page_id, '?y=2', plain || '?y=2' FROM u UNION ALL SELECT page_id, '#z', plain || query || '#z' FROM u
UNION ALL SELECT page_id, '//o.com/z', scheme || '//o.com/z' FROM u UNION ALL SELECT page_id, '/../b/./c', root || '/b/c' FROM u
UNION ALL SELECT page_id, 'mailto:x@y', 'mailto:x@y' FROM u UNION ALL SELECT page_id, '', url FROM u
UNION ALL SELECT page_id, 'g//h/', folder || 'g/h/' FROM u UNION ALL SELECT page_id, './', folder FROM u
UNION ALL SELECT page_id, 'https://o.com/a', 'https://o.com/a' FROM u""")
def url_joins(spark, sf_dir):
    refs = F.explode(F.array(*[F.lit(r) for r in _REFS]))
    p = I.table(spark, sf_dir, "pages").select("page_id", "url", refs.alias("ref"))
    return p.select("page_id", "ref", U.url_join("url", "ref").alias("target"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS a FROM pages)
SELECT page_id, array_to_string([upper(x[1]) || x[2:] for x in string_split(split_part(a, '.', 1), '-')], '-') AS name,
  array_to_string([upper(x[1]) || x[2:] for x in string_split(split_part(regexp_replace(a, '^www[.]', ''), '.', 1), '-')], ' ') AS clean_name FROM u""")
def business_names(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select(
        "page_id", U.business_name("url").alias("name"), U.business_name("url", True, True).alias("clean_name"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS a, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS rest
  FROM pages) SELECT page_id, 'https://' || a || CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END AS bare,
  'http://' || a || '/' AS shouted FROM u""")
def normalized_urls(spark, sf_dir):
    p = I.table(spark, sf_dir, "pages")
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    shouted = F.concat(F.lit(" HTTP://"), F.upper(U.url_part("url", "AUTHORITY")))
    return p.select("page_id", U.normalize_url(bare).alias("bare"), U.normalize_url(shouted).alias("shouted"))


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_words,
  list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1] AS first_word FROM documents""")
def document_words(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select(
        "doc_id", T.word_count("text").cast("long").alias("n_words"), F.get(T.words("text"), F.lit(0)).alias("first_word"))


@query("""SELECT doc_id, list_aggregate([CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:]) for w in regexp_extract_all(text, '\\pL+|\\PL+')], 'string_agg', '') AS titled
  FROM documents""")
def title_cased_texts(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", T.title_case("text").alias("titled"))


@query("""WITH s AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '[^\\pL\\pN_\\-\\s]', '', 'g'), '[-\\s]+', '-', 'g')[1:50], '-')) AS slug
  FROM documents) SELECT doc_id, CASE WHEN slug = '' THEN 'untitled' ELSE slug END AS slug FROM s""")
def document_slugs(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", T.slug("text").alias("slug"))


@query("SELECT doc_id, text, '&lt;' || text AS twice, 'Üø→²≂̸&bogus;\\' || text AS rare FROM documents")
def unescaped_texts(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    coded = I._escape(F.col("text"))
    numeric = F.replace(F.replace(coded, F.lit("E"), F.lit("&#69;")), F.lit("T"), F.lit("&#x54;"))
    return d.select("doc_id", T.unescape(numeric).alias("text"),
                    T.unescape(F.concat(F.lit("&amp;lt;"), coded)).alias("twice"),
                    T.unescape(F.concat(F.lit("&Uuml;&oslash;&rarr;&sup2;&NotEqualTilde;&bogus;&bsol;"), coded)).alias("rare"))


@query(f"""WITH {I.PAGES}, l AS (SELECT crawl_seq, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS seg FROM p)
SELECT crawl_seq, count(*) AS n, min(t) AS low, max(t) AS high
FROM (SELECT *, CASE WHEN seg[1] = 'ß' THEN 'Ss' ELSE upper(seg[1]) END || lower(seg[2:]) AS t FROM l) WHERE regexp_full_match(seg, '\\pL+') GROUP BY crawl_seq""")
def link_phrases(spark, sf_dir):
    from ..operators.parse import page_links

    p = I.pages(spark, sf_dir).withColumn("url", F.concat(F.lit("https://h.net/?id="), F.col("crawl_seq").cast("string")))
    links = page_links(p).withColumn("seg", F.substr("href", F.lit(2))).filter(F.col("seg").rlike(r"^\p{L}+$"))
    return links.groupBy(F.regexp_extract("url", r"id=(\d+)", 1).cast("long").alias("crawl_seq")).agg(
        F.count(F.lit(1)).alias("n"), F.min(U.last_segment_phrase("target")).alias("low"),
        F.max(U.last_segment_phrase("target")).alias("high"))


@query("""SELECT doc_id, CASE WHEN length(text) > 40 THEN text[1:40] || '...' ELSE text END AS title,
  CASE WHEN lang = 'de' THEN 'No title' WHEN length(text) > 10 THEN text[1:10] || '...' ELSE text END AS short FROM documents""")
def ellipsed_titles(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.ellipsis("text").alias("title"),
                    T.ellipsis(F.when(F.col("lang") != "de", F.col("text")), 10).alias("short"))


@query("""SELECT event_id, lpad(user_id::VARCHAR, 3, '0') AS padded, printf('%.1f', value) AS one, printf('%.2f', value) AS two,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events""")
def formatted_values(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")
    return e.select("event_id", T.fmt("user_id", "03d").alias("padded"), T.fmt("value", ".1f").alias("one"),
                    T.fmt("value", ".2f").alias("two"), T.fmt("ts", "iso").alias("iso"), T.fmt("ts", "stamp").alias("stamp"))


@query("""SELECT doc_id, replace(text, chr(10), ', ') AS joined FROM documents""")
def joined_lists(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", T.join_list(F.split("text", "\n")).alias("joined"))


@query("""SELECT doc_id, (contains(lower(text), 'stupid') OR contains(lower(text), 'ngo')) AS hit FROM documents""")
def contains_any_term(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", T.contains_any("text", ("Stupid", "ngo")).alias("hit"))


@query("""SELECT page_id, coalesce(nullif(regexp_extract(url, '[?]([^#]*)', 1), ''), 'none') AS query FROM pages""")
def defaulted_queries(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select("page_id", T.or_default(U.url_part("url", "QUERY"), "none").alias("query"))


@query("""SELECT conv_id, turn, sha256(conv_id || chr(31) || turn) AS job_key FROM conversations""")
def job_keys(spark, sf_dir):
    return I.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.job_key("conv_id", "turn").alias("job_key"))


@query("""SELECT vec_id, '{"vec_id":' || vec_id || ',"label":' || label || ',"note":null}' AS record FROM embeddings""")
def json_records(spark, sf_dir):
    e = I.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", T.to_json_record("vec_id", "label", F.lit(None).cast("string").alias("note")).alias("record"))


@query("""SELECT doc_id, text[1:5000] AS head FROM documents""")
def text_heads(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", T.head_text("text").alias("head"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
SELECT doc_id, i, array_to_string(ws[greatest(1, i - 2):least(len(ws), i + 2)], ' ') AS context FROM i WHERE contains(ws[i], 'stupid')""")
def context_windows(spark, sf_dir):
    w = I.table(spark, sf_dir, "documents").select("doc_id", T.words("text").alias("ws"))
    hits = F.filter(F.transform("ws", lambda x, i: F.when(
        x.contains("stupid"), F.struct((i + 1).cast("long").alias("i"), T.context_window(F.col("ws"), i + 1).alias("context")))),
        lambda h: h.isNotNull())
    return w.select("doc_id", F.inline(hits))
