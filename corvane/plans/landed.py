"""Sources: payloads of each shape are made from the supplied tables and read back as jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import upkeep
from corvane.plans.base import Tables, query
from corvane.plans.base import work_folder as _folder
from corvane.sources import boards, forms, readers
from corvane.streaming import streams


def _payloads(t: Tables, jobs, whole) -> DataFrame:
    """One payload a brand, which stands for a company, with its parts as jobs; and one that is broken."""
    rows = t.part.groupBy(F.lower("p_brand").alias("company_slug")).agg(F.to_json(whole(F.collect_list(jobs))).alias("payload"))
    broken = t.spark.createDataFrame([("broken", "<html>not json"), ("empty", "{}")], "company_slug string, payload string")
    return rows.unionByName(broken)


_JOBS = "SELECT p_partkey::VARCHAR AS job_id, lower(p_brand) AS company_slug, p_name AS title"


@query("SRC1_greenhouse", _JOBS + ", 'loc ' || p_size AS location, 'https://x.example/' || p_partkey AS apply_url, p_type AS description, CASE WHEN p_size % 2 = 0 THEN 'Sales' END AS department FROM part WHERE p_size % 10 > 0")
def greenhouse(t: Tables) -> DataFrame:
    job = F.struct(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 10 > 0, F.col("p_name")).alias("title"), F.struct(F.concat(F.lit("loc "), "p_size").alias("name")).alias("location"),
        F.concat(F.lit("https://x.example/"), "p_partkey").alias("absolute_url"), F.col("p_type").alias("content"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.lit("Sales").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>")).alias("departments"),
    )
    found = readers.greenhouse_jobs(_payloads(t, job, lambda jobs: F.struct(jobs.alias("jobs"))))
    return found.select("job_id", "company_slug", "title", "location", "apply_url", "description", "department")


@query("SRC2_lever", _JOBS + ", 'plain' || chr(10) || chr(10) || 'Needs' || chr(10) || p_type AS description, 'team' AS department, 'US' AS country FROM part")
def lever(t: Tables) -> DataFrame:
    job = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("text"), F.lit("plain").alias("descriptionPlain"),
        F.array(F.struct(F.lit("Needs").alias("text"), F.concat(F.lit("<li>"), "p_type", F.lit("</li>")).alias("content"))).alias("lists"),
        F.struct(F.lit("team").alias("department")).alias("categories"), F.lit("US").alias("country"),
    )
    found = readers.lever_jobs(_payloads(t, job, lambda jobs: jobs))
    return found.select("job_id", "company_slug", "title", "description", "department", "country")


@query("SRC3_ashby", _JOBS + ", 'https://j.example/' || p_partkey AS apply_url, p_type AS description, 'France' AS country FROM part")
def ashby(t: Tables) -> DataFrame:
    job = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("https://j.example/"), "p_partkey").alias("jobUrl"), F.concat(F.lit("<p>"), "p_type", F.lit("</p>")).alias("descriptionHtml"),
        F.struct(F.struct(F.lit("France").alias("addressCountry")).alias("postalAddress")).alias("address"),
    )
    found = readers.ashby_jobs(_payloads(t, job, lambda jobs: F.struct(jobs.alias("jobs"))))
    return found.select("job_id", "company_slug", "title", "apply_url", "description", "country")


@query("SRC4_smartrecruiters", _JOBS + ", 'Paris' AS location, 'Sales' AS department, 'fr' AS country FROM part WHERE lower(p_brand) <> 'brand#11'")
def smartrecruiters(t: Tables) -> DataFrame:
    job = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.struct(F.lit("Paris").alias("fullLocation"), F.lit("fr").alias("country")).alias("location"), F.struct(F.lit("Sales").alias("label")).alias("function")
    )
    found = readers.smartrecruiters_jobs(_payloads(t, job, lambda jobs: F.struct(F.lit(1).alias("totalFound"), jobs.alias("content"))), ["brand#11"])
    return found.select("job_id", "company_slug", "title", "location", "department", "country")


@query("SRC5_workday", "SELECT '/job/' || p_partkey AS job_id, lower(p_brand) AS company_slug, 'Sales Support Intern' AS title FROM part WHERE p_size % 2 = 1")
def workday(t: Tables) -> DataFrame:
    from corvane.functions.text import ROLE_TOKENS

    title = F.when(F.col("p_size") % 2 == 0, "Senior Engineer").otherwise("Sales Support Intern")
    job = F.struct(title.alias("title"), F.concat(F.lit("/job/"), "p_partkey").alias("externalPath"))
    keep = F.arrays_overlap(F.split(F.lower("title"), " "), F.array(*map(F.lit, ROLE_TOKENS)))
    found = readers.workday_jobs(_payloads(t, job, lambda jobs: F.struct(F.lit(1).alias("total"), jobs.alias("jobPostings"))), keep)
    return found.select("job_id", "company_slug", "title")


@query("SRC6_configured", "SELECT 'acme_' || p_partkey AS job_id, p_name AS title, 'city ' || p_size AS location, 'https://a.example/' || p_partkey || '/' || p_brand AS apply_url FROM part")
def configured(t: Tables) -> DataFrame:
    source = {"slug": "acme", "fields": {"jobs_array": "data.items", "id": "ref", "title": "names[0].text", "location": "place.city", "url_template": "https://a.example/{id}/{brand}"}}
    job = F.struct(
        F.col("p_partkey").cast("string").alias("ref"), F.array(F.struct(F.col("p_name").alias("text"))).alias("names"), F.struct(F.concat(F.lit("city "), "p_size").alias("city")).alias("place"), F.col("p_brand").alias("brand")
    )
    payloads = _payloads(t, job, lambda jobs: F.struct(F.struct(jobs.alias("items")).alias("data")))
    return readers.configured_jobs(payloads, source).select("job_id", "title", "location", "apply_url")


@query("SRC7_newer_than", "SELECT event_id FROM events WHERE event_id > 9000")
def newer_than(t: Tables) -> DataFrame:
    return readers.newer_than(t.events.select("event_id"), "event_id", 9000)


@query("SRC8_index_slugs", "SELECT DISTINCT 'acme' || (page_id % 40) AS slug FROM pages WHERE page_id % 3 > 0")
def index_slugs(t: Tables) -> DataFrame:
    line = F.when(F.col("page_id") % 3 == 0, "{broken").otherwise(F.concat(F.lit('{"url": "https://jobs.lever.co/Acme'), F.col("page_id") % 40, F.lit('/1"}')))
    return readers.index_slugs(t.pages.select(line.alias("value")), "jobs\\.lever\\.co/([^/?#]+)")


@query("SRC9_SRC10_fallback", "SELECT r_regionkey, r_name FROM region")
def fallback(t: Tables) -> DataFrame:
    schema = "r_regionkey int, r_name string"
    folder = _folder(t, "fallback")
    t.region.write.json(f"{folder}/regions")
    missing = readers.json_or_empty(t.spark, f"{folder}/absent", schema)
    return readers.first_that_has_rows(missing, readers.json_or_empty(t.spark, f"{folder}/regions", schema, multi_line=False))


@query("SRC11_SRC12_lines_tail", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 10")
def lines_tail(t: Tables) -> DataFrame:
    folder = _folder(t, "lines")
    t.nation.select("n_nationkey", "n_name").write.json(folder)
    return readers.tail(readers.json_lines(t.spark, folder, "n_nationkey int, n_name string"), "n_nationkey", 10)


@query("SRC13_flat_fields", """
    SELECT o_custkey AS ci, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS fi, o_orderkey FROM orders""")
def flat_fields(t: Tables) -> DataFrame:
    fields = F.array_sort(F.collect_list(F.struct("o_orderkey")))
    corpus = t.orders.groupBy(F.col("o_custkey").alias("ci")).agg(fields.alias("fields")).selectExpr("ci", "'c' AS company", "'j' AS job_id", "fields")
    return readers.flat_fields(corpus).select("ci", "fi", "field.o_orderkey")


@query("SRC14_files_with_precedence", "SELECT r_regionkey, r_name FROM region")
def files_with_precedence(t: Tables) -> DataFrame:
    folder = _folder(t, "decisions")
    t.region.select("r_regionkey", F.lit("old").alias("r_name")).coalesce(1).write.json(f"{folder}/1")
    t.region.select("r_regionkey", "r_name").coalesce(1).write.json(f"{folder}/2")
    rows = t.spark.read.schema("r_regionkey int, r_name string").json(f"{folder}/*").withColumn("file", F.input_file_name())
    from corvane.operators.merge import first_of

    return first_of(rows, ["r_regionkey"], [F.desc("file")]).select("r_regionkey", "r_name")


@query("SRC15_page_hashes", "SELECT sha1(text) AS page_hash FROM (SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS text FROM region)")
def page_hashes(t: Tables) -> DataFrame:
    folder = _folder(t, "pages")
    t.region.orderBy("r_regionkey").select("r_name").coalesce(1).write.option("compression", "gzip").text(folder)
    return readers.page_hashes(t.spark, f"{folder}/*.gz").select("page_hash")


@query("SRC16_page_fields", "SELECT page_id AS page, u.fi, CASE u.fi WHEN 0 THEN 'email' ELSE 'city' END AS name, CASE u.fi WHEN 0 THEN 'E-mail' ELSE 'City' END AS label FROM pages, (VALUES (0), (1)) AS u(fi)")
def page_fields(t: Tables) -> DataFrame:
    form = '<form><label for="e">E-mail</label><input id="e" name="email" type="email" required><label>City<select name="city"></select></label></form>'
    return readers.page_fields(t.pages.select("page_id", F.lit(form).alias("html")), "page_id", "html").select("page", "fi", "name", "label")


@query("SRC16_form_fields_sql", "SELECT page_id AS page, u.fi, CASE u.fi WHEN 0 THEN 'email' ELSE 'city' END AS name, CASE u.fi WHEN 0 THEN 'email' ELSE 'select' END AS itype, CASE u.fi WHEN 0 THEN 'E-mail ' || page_id ELSE 'City' END AS label, u.fi = 0 AS req FROM pages, (VALUES (0), (1)) AS u(fi)")
def form_fields_sql(t: Tables) -> DataFrame:
    """The table function, called from SQL for every page."""
    forms.register(t.spark)
    html = "concat('<form><label for=\"e\">E-mail ', page_id, '</label><input id=\"e\" name=\"email\" type=\"email\" required><label>City<select name=\"city\"></select></label></form>')"
    return t.spark.sql(f"SELECT p.page_id AS page, f.fi, f.name, f.itype, f.label, f.req FROM {{pages}} AS p, LATERAL form_fields({html}) AS f", pages=t.pages)


def _landed_boards(t: Tables, folder: str) -> None:
    """Brands as boards: their parts in pages of 50 by key, and what is left of a longer list once."""
    ranked = t.part.withColumn("at", F.expr("row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1")).withColumn("total", F.expr("count(*) OVER (PARTITION BY p_brand)"))
    job = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.struct(F.lit("Paris").alias("fullLocation"), F.lit("fr").alias("country")).alias("location"), F.struct(F.lit("Sales").alias("label")).alias("function"))
    board = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("board")
    pages = ranked.groupBy(board, (F.floor(F.col("at") / 50) * 50).cast("int").alias("offset")).agg(F.to_json(F.struct(F.max("total").cast("int").alias("totalFound"), F.collect_list(job).alias("content"))).alias("value"))
    stale = pages.groupBy("board").agg((F.max("offset") + 50).alias("offset"), F.max_by("value", "offset").alias("value"))
    boards.register(t.spark)
    landed = pages.unionByName(stale).selectExpr("board AS company_slug", "offset", "value AS payload")
    landed.write.format("boards").mode("append").save(folder)
    pages.groupBy("board").agg(F.max(F.xxhash64("value")).cast("string").alias("etag")).write.json(f"{folder}/etags")


@query("SRC4_paged_boards", "SELECT p_partkey::VARCHAR AS job_id, lower(replace(p_brand, '#', '-')) AS company_slug, p_name AS title, 'Paris' AS location FROM part WHERE p_brand <> 'Brand#11'")
def paged_boards(t: Tables) -> DataFrame:
    """Every page is a partition of the source; pages beyond a board's total are left, and so is a blocked board."""
    folder = _folder(t, "boards")
    _landed_boards(t, folder)
    boards.register(t.spark)
    pages = t.spark.read.format("boards").option("total", "totalFound").option("blocked", "brand-11").load(folder)
    return readers.smartrecruiters_jobs(pages).select("job_id", "company_slug", "title", "location")


@query("SRC3_changed_boards", "SELECT lower(replace(p_brand, '#', '-')) AS company_slug, count(*) + CASE WHEN lower(p_brand) = 'brand#12' THEN count(*) ELSE 0 END AS n FROM part GROUP BY p_brand")
def changed_boards(t: Tables) -> DataFrame:
    """Two cycles of the stream; between them one board's ETag changes, so its jobs come twice."""
    folder = _folder(t, "changed")
    _landed_boards(t, folder)
    boards.register(t.spark)
    cycle = lambda: streams.run_to_table(t.spark.readStream.format("boards").option("total", "totalFound").load(folder), folder, "read")
    cycle()
    t.spark.range(1).selectExpr("'brand-12' AS board", "'another' AS etag").write.mode("append").json(f"{folder}/etags")
    return readers.smartrecruiters_jobs(cycle()).groupBy("company_slug").agg(F.count(F.lit(1)).alias("n"))


@query("X_canonical_ids", """
    WITH s AS (SELECT 'n' || s_nationkey AS slug, 'supplier' AS ats FROM supplier UNION SELECT 'n' || c_nationkey, 'customer' FROM customer UNION SELECT 'only', 'customer'),
    k AS (SELECT slug, count(DISTINCT ats) > 1 AS several FROM s GROUP BY slug)
    SELECT slug, ats, sha256(CASE WHEN several THEN slug ELSE slug || '|' || ats END) AS canonical_id FROM s JOIN k USING (slug)""")
def canonical_ids(t: Tables) -> DataFrame:
    name = lambda df, c, ats: df.select(F.concat(F.lit("n"), c).alias("slug"), F.lit(ats).alias("ats")).distinct()
    only = t.spark.createDataFrame([("only", "customer")], "slug string, ats string")
    return upkeep.canonical_ids(name(t.supplier, "s_nationkey", "supplier").unionByName(name(t.customer, "c_nationkey", "customer")).unionByName(only), "slug", "ats")


@query("X_career_page", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '/careers' ELSE '/jobs' END AS path FROM supplier")
def career_page(t: Tables) -> DataFrame:
    order = ["/careers", "/jobs", "/career", "/join", "/work-with-us"]
    tried = t.supplier.select("s_suppkey", F.explode(F.array(*map(F.lit, order))).alias("path"))
    status = F.when((F.col("path") == "/careers") & (F.col("s_suppkey") % 3 != 0), 404).otherwise(200)
    return upkeep.career_pages(tried.withColumn("status", status), "s_suppkey", "path", "status", order)


@query("X_embedded_domain", "SELECT page_id, 'p' || page_id || '.example' AS domain FROM pages")
def embedded_domain(t: Tables) -> DataFrame:
    from corvane.functions.text import bare_domain

    state = F.concat(F.lit('<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"dataSource":{"companyResult":{"companyURL":"https://www.P'), "page_id", F.lit('.example/a"}}}}}</script>'))
    return t.pages.select("page_id", bare_domain(upkeep.embedded_domain(state)).alias("domain"))


@query("X_live_slugs", "SELECT DISTINCT 's' || (event_id % 50) AS slug FROM events WHERE event_id % 4 < 2")
def live_slugs(t: Tables) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (200, 403, 404, 500))), (F.col("event_id") % 4 + 1).cast("int"))
    return upkeep.live_slugs(t.events.select(F.concat(F.lit("s"), F.col("event_id") % 50).alias("slug"), status.alias("status")), "slug", "status")


@query("X_recent_indexes", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 4")
def recent_indexes(t: Tables) -> DataFrame:
    return upkeep.recent_indexes(t.orders, "o_orderkey", F.col("o_orderstatus") == "F", 4).select("o_orderkey")


@query("X_profile_snapshot", """SELECT c_custkey, '{"name":"' || c_name || '","school":null}' AS snapshot FROM customer""")
def profile_snapshot(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", upkeep.profile_snapshot(name=F.col("c_name"), school=F.lit(None).cast("string")).alias("snapshot"))


@query("X_bare_key_decisions", "SELECT DISTINCT p_brand AS key, split_part(p_type, ' ', 1) || '::' || p_brand AS rule_key FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')")
def bare_key_decisions(t: Tables) -> DataFrame:
    decisions = t.spark.createDataFrame([("Brand#11", "confirm"), ("Brand#12", "reject")], "key string, decision string")
    clusters = t.part.select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("rule"), F.col("p_brand").alias("key"))
    return upkeep.decisions_under_every_rule(decisions, clusters).select("key", "rule_key")


@query("X_form_prefix", "SELECT p_partkey, lower(p_brand) AS key FROM part")
def form_prefix(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", upkeep.without_form_prefix(F.concat(F.lit("form-"), F.lower("p_brand"))).alias("key"))


@query("X_regression_conflicts", "SELECT n_nationkey FROM nation WHERE n_name LIKE '%1%' AND n_regionkey = 1")
def regression_conflicts(t: Tables) -> DataFrame:
    rows = t.nation.select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("expected"))
    return upkeep.regression_conflicts(rows, "n_name", "1", "expected", "1").select("n_nationkey")


@query("X_unresolved_clusters", "SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1)")
def unresolved_clusters(t: Tables) -> DataFrame:
    return upkeep.unresolved(t.part.select("p_brand").distinct(), t.part.where("p_size = 1"), "p_brand")


@query("X_excluded_pages", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def excluded_pages(t: Tables) -> DataFrame:
    """Suppliers stand for fields, nations for companies; those of a region are on the list."""
    excluded = t.nation.where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    return upkeep.without_excluded(t.supplier, excluded, "s_nationkey").select("s_suppkey")


@query("X_residue_decisions", """
    WITH h AS (SELECT p_partkey, substr(sha256(p_name), 1, 2) AS h FROM part)
    SELECT p_partkey, CASE WHEN h < '40' THEN 'confirm' WHEN h < '60' THEN 'reject' END AS bucket, CASE WHEN h < '20' THEN 'consent_privacy_policy' WHEN h < '40' THEN 'school' END AS category FROM h""")
def residue_decisions(t: Tables) -> DataFrame:
    hashes = lambda low, high: [f"{k:02x}" for k in range(low, high)]
    made = [
        (hashes(0, 32), "confirm", "consent_privacy_policy", 1), (hashes(32, 64), "confirm", "school", 2), (hashes(48, 96), "reject", None, 3), (hashes(0, 16), "reject", None, 4),
    ]
    decisions = t.spark.createDataFrame(made, "hashes array<string>, action string, category string, rank int")
    fields = t.part.select("p_partkey", F.substring(F.sha2("p_name", 256), 1, 2).alias("field_hash"))
    return upkeep.residue_decided(fields, decisions, "field_hash").select("p_partkey", "bucket", "category")


@query("X_aggregator_names", r"""
    SELECT s_suppkey, trim(regexp_replace(lower(s_name || ' & Co.'), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
           CASE WHEN s_suppkey % 2 = 0 THEN (['software_engineering', 'cybersecurity', 'sales'])[s_suppkey % 3 + 1] ELSE (['swe', 'cyber_security', 'sales'])[s_suppkey % 3 + 1] END AS category FROM supplier""")
def aggregator_names(t: Tables) -> DataFrame:
    from corvane.functions import text

    own = F.element_at(F.array(*map(F.lit, ("swe", "cyber_security", "sales"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    kind = F.when(F.col("s_suppkey") % 2 == 0, "newgrad").otherwise("intern")
    return t.supplier.select("s_suppkey", text.slug_of_name(F.concat("s_name", F.lit(" & Co."))).alias("slug"), text.aggregator_category(own, kind).alias("category"))


@query("X_version_tag", """
    WITH h AS (SELECT sha256(n_nationkey || '|' || n_name) AS d FROM nation)
    SELECT sha256(count(*) || ':' || sum(('0x' || substr(d, 1, 8))::BIGINT) || ':' || sum(('0x' || substr(d, 9, 8))::BIGINT) || ':' || sum(('0x' || substr(d, 17, 8))::BIGINT) || ':' || sum(('0x' || substr(d, 25, 8))::BIGINT)) AS version FROM h""")
def version_tag(t: Tables) -> DataFrame:
    return upkeep.version_tag(t.nation, "n_nationkey", "n_name")


@query("M19_M20_sink_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_round_trip(t: Tables) -> DataFrame:
    from corvane.sources.sinks import write_lines

    folder = _folder(t, "sink")
    write_lines(t.nation.where("n_nationkey < 10"), folder)
    write_lines(t.nation.where("n_nationkey >= 10"), folder, compressed=True)
    return readers.json_lines(t.spark, folder, "n_nationkey int, n_name string, n_regionkey int")


@query("M20_chunked_write", """
    WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 2000 AS chunk FROM orders)
    SELECT chunk, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, sum(o_orderkey)::BIGINT AS all_keys FROM r GROUP BY chunk""")
def chunked_write(t: Tables) -> DataFrame:
    """Orders in chunks of 2,000, as they were written."""
    from corvane.sources.sinks import write_chunks

    rows = write_chunks(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), _folder(t, "chunks"), ["o_orderkey"], rounds=4)
    key = F.col("o_orderkey")
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.sum(key).alias("all_keys"))
