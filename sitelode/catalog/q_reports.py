"""Reports, rendered files and exports."""

from pyspark.sql import functions as F

from ..functions import html as H, text as T
from ..operators import facets as X, keywords as K, reports as A
from ..plans import runs
from ..plans.analysis import analyze_facets, analyze_sites
from ..plans.export import export_jobs, export_tables
from ..session import durable, scratch_path
from ..sinks import render as R, writers as W
from ..sources import read_report
from . import inputs as I
from .q_facets import WORDS, _ALL
from .q_keywords import _PLAN, _ROLL, _plan
from .registry import query

_RUN, _NEXT_RUN = "2024-05-06 07:08:09", "2024-05-07 07:08:09"


def _pages(spark, sf_dir):
    p = I.pages(spark, sf_dir).select("site_id", "crawl_seq", "url", H.page_title("html").alias("title"),
                                      H.visible_text("html").alias("text"))
    return p.select("site_id", "crawl_seq", "url", "title", T.word_count("text").alias("word_count"))


_PAGES = I.TEXTS + """, pg AS (SELECT t.site_id, t.crawl_seq, t.url, replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&') AS title,
  CASE WHEN text_content = '' THEN 0 ELSE len(string_split(text_content, ' ')) END AS wc FROM t JOIN p USING (crawl_seq)),
tot AS (SELECT site_id, count(*) AS n, sum(wc)::BIGINT AS w FROM pg GROUP BY 1)"""


def _json_pages(n: int) -> str:
    return f"""lst AS (SELECT site_id, string_agg('{{"url":' || to_json(url) || ',"title":' || to_json(title) || ',"word_count":' || wc || '}}', ',' ORDER BY crawl_seq) AS j
  FROM (SELECT * FROM pg QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY crawl_seq) <= {n}) GROUP BY 1)"""


@query(f"""WITH {_PAGES}, {_json_pages(50)} SELECT site_id, '{{"pages_crawled":' || n || ',"total_words":' || w || ',"pages":[' || j || ']}}' AS content
FROM tot JOIN lst USING (site_id)""")
def crawl_report_json(spark, sf_dir):
    return R.crawl_report_json(_pages(spark, sf_dir))


def _list(facet: str, n: int | None = None) -> str:
    cut = f"[1:{n}]" if n else ""
    return f"""coalesce((SELECT '[' || array_to_string([to_json(x) for x in list_sort(list(value)){cut}], ',') || ']' FROM clean c WHERE c.site_id = s.site_id AND facet = '{facet}'), '[]')"""


_SITES = "s AS (SELECT DISTINCT site_id, split_part(site_id, '-', 1) AS source FROM g)"
_ENTITY_JSON = "'{\"name\":\"' || upper(source[1]) || source[2:] || '\",\"homepage\":\"https://' || source || '.example.com/\"' || " + " || ".join(
    f"',\"{f}\":' || {_list(f)}" for f in ("services", "products", "locations", "industries", "target_audiences", "exclusions", "brand_terms", "unique_value_props")) + " || '}'"


@query(f"WITH {_ALL}, {_SITES} SELECT site_id, {_ENTITY_JSON} AS content FROM s")
def business_json(spark, sf_dir):
    return R.business_json(analyze_sites(I.lang_docs(spark, sf_dir), WORDS))


@query(f"""WITH {I.KEYWORDS} SELECT site_id, term, volume, ads_competition, NULL::DOUBLE AS cpc, intent, '[]' AS serp_features, false AS verified_against_site,
NULL::VARCHAR AS cannot_verify_note, 0.0::DOUBLE AS score, cluster_id, false AS is_primary, difficulty_proxy FROM k""")
def keywords_csv(spark, sf_dir):
    return R.keywords_csv(I.keywords(spark, sf_dir))


@query(f"""WITH {I.KEYWORDS} SELECT site_id, term, volume, ads_competition, intent, '[]' AS serp_features FROM k""")
def keywords_csv_file(spark, sf_dir):
    """Keyword CSV written and read back."""
    path = scratch_path(spark, "keywords")
    W.write_table(I.keywords(spark, sf_dir), path, "csv")
    schema = ("site_id string, term string, volume int, ads_competition double, cpc double, intent string, serp_features string, "
              "verified_against_site boolean, cannot_verify_note string, score double, cluster_id string, is_primary boolean, difficulty_proxy double")
    back = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return back.select("site_id", "term", "volume", "ads_competition", "intent", "serp_features")


def _clusters(spark, sf_dir):
    """Clusters whose ids repeat from site to site. Keywords are written once: the rollup reads them several times."""
    k = durable(I.keywords(spark, sf_dir))
    return K.cluster_rollup(k).withColumn("label", F.col("pillar")), k


@query(f"""{_ROLL} SELECT site_id, id, '{{"id":"' || id || '","label":"' || pillar || '","pillar":"' || pillar ||
'","total_volume":' || total_volume || ',"members_count":' || members_count || '}}' AS content FROM clu""")
def clusters_json(spark, sf_dir):
    return R.clusters_json(*_clusters(spark, sf_dir))


@query(f"WITH {I.KEYWORDS} SELECT site_id, cluster_id, count(*) AS members_count FROM k GROUP BY 1, 2")
def cluster_sizes(spark, sf_dir):
    return A.cluster_sizes(_clusters(spark, sf_dir)[1])


_SUMMARY = f"""WITH {_ALL}, {_SITES}, pg AS (SELECT site_id, crawl_seq, url, url AS title, length(text_content) AS wc FROM g),
tot AS (SELECT site_id, count(*) AS n FROM pg GROUP BY 1), {_json_pages(10)}"""


def _summary(spark, sf_dir):
    pages = I.lang_docs(spark, sf_dir)
    listed = pages.select("site_id", "crawl_seq", "url", F.col("url").alias("title"), F.length("text_content").alias("word_count"))
    names = X.site_names(pages)
    return R.run_summary_json(listed, analyze_facets(pages, WORDS, names=names), names, F.lit(_RUN).cast("timestamp"))


@query(f"""{_SUMMARY} SELECT site_id, 'demo_results_' || source || '_example_com_20240506_070809.json' AS filename, '{{"url":"https://' || source ||
'.example.com/","timestamp":"20240506_070809","pages_crawled":' || n || ',"crawl_summary":[' || j || '],"business_analysis":{{"name":"' || upper(source[1]) || source[2:] ||
'","services":' || {_list('services', 10)} || ',"products":' || {_list('products', 10)} || ',"locations":' || {_list('locations')} ||
',"target_audiences":' || {_list('target_audiences')} || '}}}}' AS content FROM s JOIN tot USING (site_id) JOIN lst USING (site_id)""")
def run_summary_json(spark, sf_dir):
    return _summary(spark, sf_dir)


@query(f"""{_SUMMARY} SELECT 'https://' || source || '.example.com/' AS url, n::INTEGER AS pages_crawled, len(list(wc))::INTEGER AS listed FROM s JOIN tot USING (site_id)
JOIN (SELECT * FROM pg QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY crawl_seq) <= 10) USING (site_id) GROUP BY s.site_id, 1, 2""")
def reports_read_back(spark, sf_dir):
    """Run summaries written as JSON lines and loaded with the report schema."""
    path = scratch_path(spark, "summary")
    W.write_rendered(_summary(spark, sf_dir), path)
    return read_report(spark, path, multi_line=False).select("url", "pages_crawled", F.size("crawl_summary").alias("listed"))


def _bullets(title: str, lang: str) -> str:
    return f"CASE WHEN lang = '{lang}' THEN '### {title}' || chr(10) || chr(10) || bl || chr(10) || chr(10) ELSE '' END"


_BRIEF = f"""WITH {I.BRIEFS}, n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY topic)::BIGINT AS idx,
  array_to_string(['- ' || x for x in lines], chr(10)) AS bl FROM b),
f AS (SELECT *, lpad(idx::VARCHAR, 3, '0') || '-plan-' || lang || '-' || doc_id || '-brief.md' AS filename, replace(
  '# ' || topic || ' - Content Brief V2.0~~---~~## Web Page Structure~~**Target URL:** https://' || source || '.example.com/~**H1:** H ' || source ||
  '~**Page Title:** ' || lines[1] || '~**Meta Description:** ' || lines[1] || '~~## AI Optimisation~~### Key Takeaways~*To appear directly under the H1*~~' || bl || '~~' ||
  {_bullets('Definitions', 'de')} || {_bullets('Key Statistics', 'fr')} || {_bullets('Decision Tips', 'es')} ||
  '## Keywords~~**Primary Keyword:** ' || lang || '~**Secondary Keywords:** ' || array_to_string([split_part(x, ' ', 1) for x in lines], ', ') ||
  '~~## Internal Linking~~| URL | Anchor Text | Relevance |~|-----|-------------|-----------|~' ||
  array_to_string(['| https://' || source || '.example.com/' || (i - 1) || ' | see | ' || printf('%.1f', (i - 1) / 8) || ' |' for x, i in lines], '~') ||
  '~~## Writing Guidelines~~**Target Audience:** readers~**Tone:** ' || CASE lang WHEN 'en' THEN 'professional' WHEN 'de' THEN 'academic' ELSE 'plain' END ||
  '~**POV:** third_person~**Word Count:** 800-1200 words~~### Requirements~~- ' || lang || '~~## Suggested Headings~~' ||
  coalesce(nullif(array_to_string([CASE (i - 1) % 4 WHEN 1 THEN '## ' WHEN 2 THEN '### ' ELSE '#### ' END || x for x, i in lines if (i - 1) % 4 <> 0], '~'), '') || '~', '') ||
  '~## Frequently Asked Questions~*Must be the last section with exactly 4 FAQs*~~' ||
  array_to_string(['### Q' || (i - 1) || '~~' || x || '~' for x, i in lines], '~') || '~## Call to Action~~Call us~', '~', chr(10)) AS content FROM n)"""


@query(f"{_BRIEF} SELECT site_id, idx, topic, filename, content FROM f")
def brief_files(spark, sf_dir):
    return R.render_briefs(I.briefs(spark, sf_dir))


_DRAFT = """dr AS (SELECT source AS site_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS idx, 'Plan & ' || lang || ' ' || doc_id AS brief_id, lang, doc_id,
  text, n_chars::INTEGER AS word_count FROM documents),
df AS (SELECT site_id, idx, brief_id, lpad(idx::VARCHAR, 3, '0') || '-plan-' || lang || '-' || doc_id || '-draft.md' AS filename, word_count,
  '---' || chr(10) || 'brief_id: ' || brief_id || chr(10) || 'word_count: ' || word_count || chr(10) || 'readability_score: ' || printf('%.2f', word_count / 8) || chr(10) ||
  'uk_english_verified: ' || CASE WHEN lang = 'en' THEN 'True' ELSE 'False' END || chr(10) || 'facts_verified: False' || chr(10) ||
  'created_at: 2024-05-06T07:08:09' || chr(10) || '---' || chr(10) || chr(10) || text || chr(10) AS content FROM dr)"""


@query(f"WITH {_DRAFT} SELECT site_id, idx, brief_id, filename, word_count, content FROM df")
def draft_files(spark, sf_dir):
    return R.render_drafts(I.drafts(spark, sf_dir))


_INDEX = f"""{_BRIEF}, {_DRAFT}, {I.CALENDAR}"""


@query(f"""{_INDEX} SELECT cal.site_id, cal.idx, cal.topic, f.filename AS brief_file, df.filename AS draft_file, df.word_count AS draft_words
FROM cal LEFT JOIN f ON f.site_id = cal.site_id AND f.idx = cal.idx LEFT JOIN df ON df.site_id = cal.site_id AND df.idx = cal.idx""")
def calendar_files(spark, sf_dir):
    return R.calendar_files(I.calendar(spark, sf_dir), R.render_briefs(I.briefs(spark, sf_dir)), R.render_drafts(I.drafts(spark, sf_dir))).select(
        "site_id", "idx", "topic", "brief_file", "draft_file", "draft_words")


@query(f"""{_INDEX} SELECT cal.site_id, cal.idx, cal.week, cal.topic, content_type, primary_keyword, array_to_string(secondary_keywords, ', ') AS secondary_keywords,
cluster_id AS cluster, priority, coalesce(f.filename, '') AS brief_file, coalesce(df.filename, '') AS draft_file, coalesce(df.word_count, 0) AS word_count,
coalesce('briefs/' || f.filename, '') AS brief_link, coalesce('drafts/' || df.filename, '') AS draft_link
FROM cal LEFT JOIN f ON f.site_id = cal.site_id AND f.idx = cal.idx LEFT JOIN df ON df.site_id = cal.site_id AND df.idx = cal.idx""")
def calendar_index(spark, sf_dir):
    return R.calendar_index(I.calendar(spark, sf_dir), R.render_briefs(I.briefs(spark, sf_dir)), R.render_drafts(I.drafts(spark, sf_dir)))


@query(f"""{_PLAN} SELECT site_id, week::BIGINT AS idx, pillar AS topic, lpad(week::VARCHAR, 3, '0') || '-draft.md' AS draft_file FROM plan""")
def planned_calendar_index(spark, sf_dir):
    """The index of the built calendar: its positions pair the drafts, whatever their order by name."""
    plan = _plan(spark, sf_dir)
    files = plan.select("site_id", "idx", F.concat(T.fmt("idx", "03d"), F.lit("-draft.md")).alias("filename"), F.lit(1).alias("word_count"))
    return R.calendar_index(plan, files, files).select("site_id", "idx", "topic", "draft_file")


_EXPORT_COUNTS = """SELECT source AS site_id, count(*) AS briefs_count, count(*) AS drafts_count FROM documents GROUP BY 1"""


def _export_inputs(spark, sf_dir):
    return {"briefs": I.briefs(spark, sf_dir), "drafts": I.drafts(spark, sf_dir)}


@query(_EXPORT_COUNTS)
def export_summary(spark, sf_dir):
    t = _export_inputs(spark, sf_dir)
    return A.export_summary(t["briefs"], t["drafts"])


@query("SELECT source AS site_id, 0::BIGINT AS briefs_count, count(*) AS drafts_count FROM documents GROUP BY 1")
def export_without_briefs(spark, sf_dir):
    return export_tables(_export_inputs(spark, sf_dir), include_briefs=False)["summary"]


@query("""SELECT source AS client_slug, run, count(*) AS n, sum(length(text))::BIGINT AS n_chars
FROM documents, (SELECT unnest(['r20240506_070809', 'r20240507_070809']) AS run) GROUP BY 1, 2""")
def export_layout(spark, sf_dir):
    """Drafts written by client and run, twice; the second run leaves the first in place. Read back with partition discovery."""
    path = scratch_path(spark, "layout")
    names = X.site_names(I.docs(spark, sf_dir))
    drafts = durable(I.drafts(spark, sf_dir).select("site_id", "idx", "content"))
    for run in (_RUN, _NEXT_RUN):
        W.write_layout(drafts, path, names, F.lit(run).cast("timestamp"))
    back = spark.read.schema("site_id string, idx long, content string, client_slug string, run_ts string").parquet(path)
    return back.groupBy("client_slug", F.concat(F.lit("r"), "run_ts").alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("content").cast("long")).alias("n_chars"))


@query("""SELECT source AS client_slug, run, output, count(*) AS n_rows, true AS n_read FROM documents,
  (SELECT unnest(['r20240506_070809', 'r20240507_070809']) AS run), (SELECT unnest(['briefs', 'drafts']) AS output) GROUP BY 1, 2, 3
UNION ALL SELECT DISTINCT source, run, 'summary', 1, true FROM documents, (SELECT unnest(['r20240506_070809', 'r20240507_070809']) AS run)""")
def export_runs(spark, sf_dir):
    """Two runs, the first of them written again in place of itself: what the manifest says of them, and whether that many rows are read."""
    base = scratch_path(spark, "runs")
    # Numbered documents are a written table; what briefs say of a text is made anew for each run.
    names, tables = X.site_names(I.docs(spark, sf_dir)), _export_inputs(spark, sf_dir)
    for run, replace in ((_RUN, False), (_NEXT_RUN, False), (_RUN, True)):
        export_jobs(tables, base, names, F.lit(run).cast("timestamp"), replace=replace)
    said = runs.current(spark, base)
    read = R.union_all([runs.read_export(spark, base, name, "site_id string").withColumn("output", F.lit(name))
                        for name in ("briefs", "drafts", "summary")]).groupBy("run", "client_slug", "run_ts", "output").agg(F.count(F.lit(1)).alias("_n"))
    return said.join(read, ["run", "client_slug", "run_ts", "output"], "left").select(
        "client_slug", F.concat(F.lit("r"), "run_ts").alias("run"), "output", "n_rows", (F.col("n_rows").eqNullSafe(F.col("_n"))).alias("n_read"))


@query(f"""{_ROLL}, docs AS (SELECT count(*) AS n, count(DISTINCT source) AS sites FROM documents), {I.PAGES}
SELECT unnest(['briefs', 'drafts', 'content-calendar-index', 'crawl-report', 'business-analysis', 'keywords', 'clusters', 'summary']) AS output,
  unnest([n, n, (SELECT count(*) FROM orders), (SELECT count(DISTINCT site_id) FROM p), sites, (SELECT count(*) FROM k), (SELECT count(*) FROM clu), sites]) AS n FROM docs""")
def full_export(spark, sf_dir):
    """All seven inputs of an export written as JSON; returns the rows of each output, counted in the files."""
    docs = I.docs(spark, sf_dir)
    clusters, keywords = _clusters(spark, sf_dir)
    tables = {**_export_inputs(spark, sf_dir), "pages": _pages(spark, sf_dir), "entity": analyze_sites(docs, WORDS),
              "keywords": keywords, "clusters": clusters, "calendar": I.calendar(spark, sf_dir)}
    base = scratch_path(spark, "export")
    export_jobs(tables, base, X.site_names(docs), F.lit(_RUN).cast("timestamp"))
    return R.union_all([runs.read_export(spark, base, name, "site_id string").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("output"), "n") for name in export_tables(tables)])


@query("""SELECT f AS format, doc_id, text FROM documents, (SELECT unnest(['csv', 'json', 'parquet']) AS f)""")
def export_formats(spark, sf_dir):
    """One table in each export format, read back."""
    d = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    back = []
    for fmt in W.FORMATS:
        path = scratch_path(spark, f"format-{fmt}")
        W.write_table(d, path, fmt)
        reader = spark.read.schema("doc_id long, text string")
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True) if fmt == "csv" else reader
        back.append(reader.format(fmt).load(path).select(F.lit(fmt).alias("format"), "doc_id", "text"))
    return R.union_all(back)
