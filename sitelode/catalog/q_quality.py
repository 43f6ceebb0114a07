"""Record rules over derived tables: violations as rows, and pass/fail counts."""

from dataclasses import asdict

from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import html as H, text as T
from ..operators import keywords as K
from ..operators.quality import rule_counts, rules_for, validate, with_defaults
from . import inputs as I
from .q_keywords import _PAIRS, _PLAN, _ROLL, _VOLUME, _client, _plan, _volumes
from .registry import query


def _violations(table: str, source: str, key: str, rules: list[tuple[str, str, str, str]]) -> str:
    """SQL for rows failing ``(field, rule, condition, shown value)`` rules."""
    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", ({key})::VARCHAR AS key, '{field}' AS field, '{rule}' AS rule, ({shown})::VARCHAR AS value "
        f"FROM {source} WHERE NOT coalesce({ok}, true)" for field, rule, ok, shown in rules)


def _raw_keywords(spark, sf_dir):
    """Order lines as keyword rows, some outside the ranges."""
    li = I.table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
                    F.col("l_suppkey").cast("string")).alias("term"),
        (F.col("l_quantity").cast("int") - 2).alias("volume"), (F.col("l_discount") * 11).alias("ads_competition"),
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity") - 3).alias("cpc"), F.lit(0.5).alias("score"),
        (F.col("l_quantity") * 2 + 1).alias("difficulty_proxy"),
        F.when(F.col("l_linestatus") == "O", "commercial").when(F.col("l_returnflag") == "N", "other").alias("intent"))


@query(f"""WITH kw AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS term, l_quantity::INTEGER - 2 AS volume, l_discount * 11 AS comp,
  CASE WHEN l_returnflag = 'A' THEN l_quantity - 3 END AS cpc, l_quantity * 2 + 1 AS diff,
  CASE WHEN l_linestatus = 'O' THEN 'commercial' WHEN l_returnflag = 'N' THEN 'other' END AS intent FROM lineitem),
v AS ({_violations('keyword', 'kw', 'term', [
    ('intent', 'required', 'intent IS NOT NULL', 'intent'), ('volume', 'min_0', 'volume >= 0', 'volume'),
    ('ads_competition', 'range_0_1', 'comp BETWEEN 0 AND 1', 'NULL'), ('cpc', 'min_0', 'cpc >= 0', 'cpc'),
    ('difficulty_proxy', 'range_0_100', 'diff BETWEEN 0 AND 100', 'diff'),
    ('intent', 'allowed', "intent IN ('informational', 'commercial', 'transactional', 'navigational')", 'intent')])})
SELECT "table", key, field, rule, value FROM v""")
def keyword_violations(spark, sf_dir):
    v = validate(_raw_keywords(spark, sf_dir), rules_for("keyword"), "term", "keyword")
    return v.withColumn("value", F.when(F.col("field") != "ads_competition", F.col("value")))


@query("""WITH kw AS (SELECT l_quantity::INTEGER - 2 AS volume, l_discount * 11 AS comp, CASE WHEN l_returnflag = 'A' THEN l_quantity - 3 END AS cpc,
  l_quantity * 2 + 1 AS diff, CASE WHEN l_linestatus = 'O' THEN 'commercial' WHEN l_returnflag = 'N' THEN 'other' END AS intent FROM lineitem),
r AS (SELECT unnest(['term', 'volume', 'intent', 'volume', 'ads_competition', 'cpc', 'score', 'difficulty_proxy', 'intent']) AS field,
  unnest(['required', 'required', 'required', 'min_0', 'range_0_1', 'min_0', 'min_0', 'range_0_100', 'allowed']) AS rule,
  unnest([true, true, intent IS NOT NULL, volume >= 0, comp BETWEEN 0 AND 1, coalesce(cpc >= 0, true), true, diff BETWEEN 0 AND 100,
    coalesce(intent = 'commercial', true)]) AS ok FROM kw)
SELECT 'keyword' AS "table", field, rule, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed FROM r GROUP BY 1, 2, 3""")
def keyword_rule_counts(spark, sf_dir):
    return rule_counts(_raw_keywords(spark, sf_dir), rules_for("keyword"), "keyword")


@query(f"""{_ROLL}, x AS (SELECT site_id || '/' || id AS id, CASE WHEN members_count > 8 THEN 3 ELSE 0 END AS n_primary, avg_volume - 4 AS av,
  CASE WHEN dominant_intent <> 'commercial' THEN dominant_intent ELSE 'mixed' END AS di, CASE WHEN dominant_intent <> 'commercial' THEN content_type_suggestion END AS ct FROM clu),
v AS ({_violations('cluster', 'x', 'id', [
    ('content_type_suggestion', 'required', 'ct IS NOT NULL', 'ct'), ('primary_terms', 'size_1_up', 'n_primary >= 1', 'n_primary'), ('avg_volume', 'min_0', 'av >= 0', 'NULL'),
    ('dominant_intent', 'allowed', "di <> 'mixed'", 'di')])}) SELECT "table", key, field, rule, value FROM v""")
def cluster_violations(spark, sf_dir):
    odd = F.col("dominant_intent") == "commercial"
    c = K.cluster_rollup(I.keywords(spark, sf_dir)).select(
        F.concat_ws("/", "site_id", "id").alias("id"), F.col("pillar").alias("label"), "pillar", "total_volume",
        (F.col("avg_volume") - 4).alias("avg_volume"),
        F.when(F.col("members_count") > 8, F.col("primary_terms")).otherwise(F.array().cast("array<string>")).alias("primary_terms"),
        F.when(odd, "mixed").otherwise(F.col("dominant_intent")).alias("dominant_intent"),
        F.when(~odd, F.col("content_type_suggestion")).alias("content_type_suggestion"))
    v = validate(c, rules_for("cluster"), "id", "cluster")
    return v.withColumn("value", F.when(F.col("field") != "avg_volume", F.col("value")))


@query(f"""{_PAIRS}, {_VOLUME},
gap AS (SELECT best.site_id || '/' || keyword AS keyword, CASE WHEN volume % 7 > 0 THEN volume - 160 END AS volume, CASE WHEN client_position IS NULL THEN 'missing' WHEN client_position > 12 THEN 'lost' ELSE 'underperforming' END AS kind
  FROM best LEFT JOIN own USING (site_id, keyword) JOIN vol USING (keyword) WHERE client_position IS NULL OR client_position > best_rival),
v AS ({_violations('gap', 'gap', 'keyword', [
    ('volume', 'required', 'volume IS NOT NULL', 'volume'), ('volume', 'min_0', 'volume >= 0', 'volume'), ('opportunity_type', 'allowed', "kind <> 'lost'", 'kind')])})
SELECT "table", key, field, rule, value FROM v""")
def gap_violations(spark, sf_dir):
    gaps = K.gap_analysis(_client(spark, sf_dir), _volumes(spark, sf_dir)).withColumn("keyword", F.concat_ws("/", "site_id", "keyword")).withColumn(
        "volume", F.when(F.col("volume") % 7 > 0, F.col("volume") - 160)).withColumn(
        "opportunity_type", F.when(F.col("client_position") > 12, "lost").otherwise(F.col("opportunity_type")))
    return validate(gaps, rules_for("gap"), "keyword", "gap")


@query(f"""WITH {I.CALENDAR}, x AS (SELECT topic, week, len(secondary_keywords) AS n, CASE WHEN priority <> 'low' THEN priority END AS priority, content_type FROM cal),
v AS ({_violations('calendar', 'x', 'topic', [('priority', 'required', 'priority IS NOT NULL', 'priority'),
    ('week', 'range_1_52', 'week BETWEEN 1 AND 52', 'week'), ('secondary_keywords', 'size_3_6', 'n BETWEEN 3 AND 6', 'n')])})
SELECT "table", key, field, rule, value FROM v""")
def calendar_violations(spark, sf_dir):
    c = I.calendar(spark, sf_dir).withColumn("priority", F.when(F.col("priority") != "low", F.col("priority")))
    return validate(c, rules_for("calendar"), "topic", "calendar")


@query(f"""{_PLAN}, v AS ({_violations('calendar', 'plan', "site_id || '/' || week", [
    ('week', 'range_1_52', 'week BETWEEN 1 AND 52', 'week'), ('content_type', 'allowed', "content_type_suggestion <> 'none'", 'id')])})
SELECT count(*) AS violations FROM v""")
def planned_calendar_violations(spark, sf_dir):
    """The built calendar satisfies its own rules."""
    plan = _plan(spark, sf_dir).withColumn("key", F.concat_ws("/", "site_id", F.col("week").cast("string")))
    return validate(plan, rules_for("calendar"), "key", "calendar").agg(F.count(F.lit(1)).alias("violations"))


def _links(spark, sf_dir):
    """Brief links as rows: every other URL loses its scheme."""
    d = I.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select(
        F.concat_ws("/", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("key"),
        F.concat(F.when(F.col("i") % 2 == 0, "https://").otherwise(""), F.lit("h.example/a"), F.col("i").cast("string")).alias("url"),
        F.col("line").alias("anchor_text"), F.when(F.col("i") % 5 < 4, F.col("i") / 8).alias("relevance_score"))


@query(f"""WITH {I.DOC_LINES}, x AS (SELECT crawl_seq || '/' || i AS key, CASE WHEN i % 2 = 0 THEN 'https://' ELSE '' END || 'h.example/a' || i AS url, CASE WHEN i % 5 < 4 THEN i / 8 END AS rel FROM l),
v AS ({_violations('link', 'x', 'key', [('url', 'url', "url LIKE 'https://%'", 'url'), ('relevance_score', 'required', 'rel IS NOT NULL', 'rel'), ('relevance_score', 'range_0_1', 'rel BETWEEN 0 AND 1', 'rel')])})
SELECT "table", key, field, rule, value FROM v""")
def link_violations(spark, sf_dir):
    return validate(_links(spark, sf_dir), rules_for("link"), "key", "link")


@query(f"""WITH x AS (SELECT conv_id || '/' || turn AS key, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n, role FROM conversations),
v AS ({_violations('faq', 'x', 'key', [('answer', 'words_min_30', 'n >= 30', 'n')])}) SELECT "table", key, field, rule, value FROM v""")
def faq_violations(spark, sf_dir):
    c = I.table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
        F.col("role").alias("question"), F.col("text").alias("answer"))
    return validate(c, rules_for("faq"), "key", "faq")


@query(f"""WITH {I.BRIEFS}, x AS (SELECT doc_id, len(lines) AS n, length(lines[1]) AS len1, lang,
  len([y for y, i in lines if i - 1 > 8]) AS far, len([y for y in lines if len(list_filter(regexp_split_to_array(y, '\\s+'), lambda w: w <> '')) < 30]) AS short FROM b),
v AS ({_violations('brief', 'x', 'doc_id', [
    ('cta', 'required', "lang <> 'fr'", 'NULL'), ('secondary_keywords', 'size_3_6', 'n BETWEEN 3 AND 6', 'n'), ('page_title', 'length_0_60', 'len1 <= 60', 'len1'),
    ('meta_description', 'length_120_160', 'len1 BETWEEN 120 AND 160', 'len1'), ('key_takeaways', 'size_3_5', 'n BETWEEN 3 AND 5', 'n'),
    ('internal_links', 'size_3_up', 'n >= 3', 'n'), ('faqs', 'size_4_4', 'n = 4', 'n'), ('tone', 'allowed', "lang IN ('en', 'de')", "'plain'"),
    ('internal_links', 'relevance_0_1', 'far = 0', 'far'), ('faqs', 'answer_words_min_30', 'short = 0', 'short')])})
SELECT "table", key, field, rule, value FROM v""")
def brief_violations(spark, sf_dir):
    b = I.briefs(spark, sf_dir).withColumn("cta", F.when(F.col("primary_keyword") != "fr", F.col("cta")))
    return validate(b, rules_for("brief"), "doc_id", "brief")


@query(f"""WITH {I.PAGES}, x AS (SELECT crawl_seq, CASE WHEN url LIKE 'https%' THEN url ELSE regexp_replace(url, '^[a-z]+:', '') END AS url FROM p),
v AS ({_violations('crawl', 'x', 'crawl_seq', [('url', 'url', "url LIKE 'https://%'", 'url')])}) SELECT "table", key, field, rule, value FROM v""")
def crawl_violations(spark, sf_dir):
    p = I.pages(spark, sf_dir).select(
        "crawl_seq", F.when(F.col("url").startswith("https"), F.col("url")).otherwise(F.regexp_replace("url", "^[a-z]+:", "")).alias("url"),
        F.lit(200).alias("status_code"), H.visible_text("html").alias("text_content"))
    return validate(p.withColumn("word_count", T.word_count("text_content")), rules_for("crawl"), "crawl_seq", "crawl")


@query(f"""WITH {I.JOBS}, v AS ({_violations('job', 'c', 'job_id', [
    ('progress', 'range_0_100', 'progress BETWEEN 0 AND 100', 'progress'), ('status', 'allowed', "status = 'completed'", 'status')])})
SELECT "table", key, field, rule, value FROM v""")
def job_violations(spark, sf_dir):
    return validate(I.jobs(spark, sf_dir), rules_for("job"), "job_id", "job")


@query("""SELECT c_custkey AS job_id, 'https://a.example' AS url, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'de-DE' ELSE 'en-GB' END AS locale FROM customer""")
def job_requests(spark, sf_dir):
    """Requests with the default locale filled in."""
    c = I.table(spark, sf_dir, "customer")
    locale = F.when(F.col("c_mktsegment") == "MACHINERY", " de-DE ").when(F.col("c_acctbal") > 0, " ")
    return with_defaults(c.select(F.col("c_custkey").alias("job_id"), F.lit(" https://a.example ").alias("url"), locale.alias("locale")))


@query(f"""WITH x AS (SELECT o_orderkey AS id, (o_orderkey % 4)::INTEGER AS pages, (o_orderkey % 10) / 10 AS delay, (o_orderkey % 7)::INTEGER AS size,
  CASE o_orderstatus WHEN 'F' THEN 'csv' WHEN 'O' THEN 'pdf' ELSE 'excel' END AS fmt FROM orders),
v AS ({_violations('config', 'x', 'id', [
    ('max_pages', 'min_1', 'pages >= 1', 'pages'), ('crawl_delay', 'min_0.5', 'delay >= 0.5', 'delay'),
    ('min_cluster_size', 'min_2', 'size >= 2', 'size'), ('export_format', 'allowed', "fmt <> 'pdf'", 'fmt')])})
SELECT "table", key, field, rule, value FROM v""")
def config_violations(spark, sf_dir):
    """Order rows as run configurations: four fields vary, the others keep their defaults."""
    varied = ("content_mix", "max_pages", "crawl_delay", "min_cluster_size", "export_format")
    defaults = {k: v for k, v in asdict(RunConfig()).items() if k not in varied}
    o = I.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("config_id"), (F.col("o_orderkey") % 4).cast("int").alias("max_pages"),
        (F.col("o_orderkey") % 10 / 10).alias("crawl_delay"), (F.col("o_orderkey") % 7).cast("int").alias("min_cluster_size"),
        F.when(F.col("o_orderstatus") == "F", "csv").when(F.col("o_orderstatus") == "O", "pdf").otherwise("excel").alias("export_format"),
        *[F.lit(v).alias(k) for k, v in defaults.items()])
    return validate(o, rules_for("config"), "config_id", "config")
