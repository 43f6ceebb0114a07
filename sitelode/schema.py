"""Table layouts and allowed values (fixed by the declared data model)."""

# Enumerations of the data model.
CONTENT_TYPES = ("blog", "service", "product", "landing", "comparison")
INTENTS = ("informational", "commercial", "transactional", "navigational")
JOB_STATUSES = (
    "pending", "crawling", "analyzing", "researching", "clustering", "generating",
    "writing", "reviewing", "exporting", "completed", "failed",
)
PRIORITIES = ("high", "medium", "low")
TONES = ("professional", "conversational", "academic", "friendly")
POINTS_OF_VIEW = ("first_person", "second_person", "third_person")
OPPORTUNITIES = ("missing", "underperforming")

# Facet names, in the order of the business record.
FACETS = (
    "services", "products", "locations", "industries",
    "target_audiences", "exclusions", "brand_terms", "unique_value_props",
)

PAGES = "page_id bigint, url string, html string"
PAGES_PARSED = (
    "site_id string, crawl_seq bigint, url string, status_code int, title string, meta_description string, "
    "h1 string, headings map<string,array<string>>, text_content string, internal_links array<string>, "
    "external_links array<string>, images array<string>, word_count int, crawled_at timestamp"
)
KEYWORDS = (
    "site_id string, term string, volume int, ads_competition double, cpc double, intent string, "
    "serp_features array<string>, verified_against_site boolean, cannot_verify_note string, score double, "
    "cluster_id string, is_primary boolean, difficulty_proxy double"
)
CALENDAR = (
    "site_id string, week int, topic string, content_type string, primary_keyword string, "
    "secondary_keywords array<string>, cluster_id string, target_url string, "
    "estimated_effort_hours double, priority string"
)
BRIEFS = (
    "site_id string, idx int, topic string, primary_keyword string, secondary_keywords array<string>, "
    "content_type string, target_url string, h1 string, page_title string, meta_description string, "
    "key_takeaways array<string>, definitions array<string>, key_stats array<string>, "
    "decision_tips array<string>, "
    "internal_links array<struct<url:string,anchor_text:string,relevance_score:double>>, "
    "audience string, tone string, pov string, word_count_min int, word_count_max int, "
    "sources array<struct<name:string,url:string>>, cta string, restrictions array<string>, "
    "requirements array<string>, headings_outline array<struct<level:string,text:string>>, "
    "faqs array<struct<question:string,answer:string>>"
)
DRAFTS = (
    "site_id string, idx int, brief_id string, content string, word_count int, readability_score double, "
    "grammar_check_passed boolean, uk_english_verified boolean, internal_links_validated boolean, "
    "facts_verified boolean, verification_notes array<string>, created_at timestamp"
)
JOBS = (
    "job_id string, url string, locale string, status string, progress double, created_at timestamp, "
    "updated_at timestamp, completed_at timestamp, error string, export_folder string, excel_path string"
)
REPORT = (
    "url string, timestamp string, pages_crawled int, "
    "crawl_summary array<struct<url:string,title:string,word_count:int>>, "
    "business_analysis struct<name:string,services:array<string>,products:array<string>,"
    "locations:array<string>,target_audiences:array<string>>"
)
