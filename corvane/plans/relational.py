"""Joins, aggregates, filters, order and set operations on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators import aggregates, filters, joins, windows
from corvane.plans.base import Tables, query


@query("A3_outcome_rollup", """
    SELECT event_type, count(*) AS n, coalesce(sum(value), 0) AS total FROM events
    WHERE ts > TIMESTAMP '2024-01-01' GROUP BY event_type""")
def outcome_rollup(t: Tables) -> DataFrame:
    return aggregates.rollup(t.events.where("ts > TIMESTAMP '2024-01-01'"), ["event_type"], "value")


@query("A1_filtered_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def filtered_count(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F' AND o_totalprice > 1000").agg(F.count(F.lit(1)).alias("n"))


@query("A2_group_count", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def group_count(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("A4_next_version", "SELECT user_id, coalesce(max(event_id), 0) + 1 AS next_version FROM events GROUP BY user_id")
def next_version(t: Tables) -> DataFrame:
    return aggregates.next_number(t.events, ["user_id"], "event_id", "next_version")


@query("A5_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("A6_phase_outcome_pivot", """
    SELECT event_type AS outcome, count(*) FILTER (user_id % 2 = 0) AS phase_a, count(*) FILTER (user_id % 2 = 1) AS phase_b, count(*) AS total
    FROM events GROUP BY event_type""")
def phase_outcome_pivot(t: Tables) -> DataFrame:
    phased = t.events.withColumn("phase", F.when(F.col("user_id") % 2 == 0, "A").otherwise("B"))
    return aggregates.phase_table(phased, "event_type", "phase", ["A", "B"]).withColumnRenamed("event_type", "outcome")


@query("A7_dup_group_merge", """
    WITH l AS (SELECT *, l_linenumber::BIGINT * 1000000000 + l_partkey AS seq, l_returnflag || l_linestatus AS f FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, f ORDER BY seq, l_shipdate) AS k FROM l)
    SELECT l_orderkey, min(seq) AS first_seq, string_agg(f, ',' ORDER BY seq, f) AS flags FROM k WHERE k = 1 GROUP BY l_orderkey""")
def dup_group_merge(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("flag", F.concat("l_returnflag", "l_linestatus")).withColumn("seq", F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey"))
    merged = aggregates.merge_duplicates(rows.withColumn("first_seq", F.col("seq")), ["l_orderkey"], "seq", ["first_seq"], "flag")
    return merged.select("l_orderkey", "first_seq", F.array_join("flag", ",").alias("flags"))


@query("A8_share_histogram", """
    SELECT event_type, n, round_even(100.0 * n / sum(n) OVER (), 1) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)""")
def share_histogram(t: Tables) -> DataFrame:
    return aggregates.share_histogram(t.events, "event_type")


@query("A12_bucket_ids", """
    SELECT bucket, doc_id, count(*) OVER (PARTITION BY bucket) AS n FROM
    (SELECT doc_id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END AS bucket FROM documents)""")
def bucket_ids(t: Tables) -> DataFrame:
    bucket = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    return aggregates.buckets_with_ids(t.documents.withColumn("bucket", bucket), "bucket", "doc_id")


@query("A15_distinct_in_order", """
    SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM
    (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id""")
def distinct_in_order(t: Tables) -> DataFrame:
    found = aggregates.distinct_in_order(t.events, ["user_id"], "event_type", "event_id")
    return found.select("user_id", F.array_join("event_type", ",").alias("types"))


@query("A16_run_counters", """
    SELECT CASE WHEN value IS NULL THEN 'failed' WHEN event_type = 'error' THEN 'queued' ELSE 'added' END AS result, count(*) AS n FROM events GROUP BY 1""")
def run_counters(t: Tables) -> DataFrame:
    result = F.when(F.col("value").isNull(), "failed").when(F.col("event_type") == "error", "queued").otherwise("added")
    return t.events.groupBy(result.alias("result")).agg(F.count(F.lit(1)).alias("n"))


@query("A17_recent_all_clean", """
    SELECT bool_and(event_type <> 'error') AS clean, count(*) AS n FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 150)""")
def recent_all_clean(t: Tables) -> DataFrame:
    return aggregates.recent_all(t.events, [F.desc("ts"), F.desc("event_id")], F.col("event_type") != "error", 150, "clean")


@query("A18_metric_cube", """
    WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS users, grouping(o_orderstatus) AS gs
               FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority)))
    SELECT CASE WHEN gs = 0 THEN 'status' ELSE 'priority' END AS dimension, coalesce(o_orderstatus, o_orderpriority) AS dimension_value,
           metric, v::BIGINT AS metric_value FROM g, (VALUES ('orders'), ('users')) AS m(metric),
           LATERAL (SELECT CASE metric WHEN 'orders' THEN n ELSE users END AS v) WHERE users >= 5""")
def metric_cube(t: Tables) -> DataFrame:
    return aggregates.metric_cube(t.orders, {"status": "o_orderstatus", "priority": "o_orderpriority"}, "o_custkey", 5)


@query("A18_anonymous_cube", """
    WITH o AS (SELECT (l_quantity::INT)::VARCHAR AS f, date_trunc('month', l_shipdate)::DATE::VARCHAR AS s, l_suppkey AS u FROM lineitem),
    g AS (SELECT f, s, grouping(f) AS ta, grouping(s) AS tb, count(*) AS n, count(DISTINCT u) AS users FROM o GROUP BY GROUPING SETS ((f, s), (f), (s), ())),
    c AS (SELECT *, CASE WHEN ta = 1 THEN '*' ELSE 'v' || f END AS a, CASE WHEN tb = 1 THEN '*' ELSE 'v' || s END AS b, users < 5 AS few, CASE WHEN users < 5 THEN 0 ELSE users END AS cost FROM g),
    r AS (SELECT a, b AS b2, cost FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY cost, b) <= 8 OR b = '*'),
    k AS (SELECT b, a AS a2, cost FROM c QUALIFY row_number() OVER (PARTITION BY b ORDER BY cost, a) <= 8 OR a = '*'),
    m AS (SELECT c.a, c.b, k.a2, r.b2 FROM c JOIN r ON r.a = c.a AND r.b2 <> c.b JOIN k ON k.b = c.b AND k.a2 <> c.a JOIN c AS d ON d.a = k.a2 AND d.b = r.b2 WHERE c.few
          QUALIFY row_number() OVER (PARTITION BY c.a, c.b ORDER BY r.cost + k.cost + d.cost, k.a2, r.b2) = 1),
    x AS (SELECT a, b FROM c WHERE few UNION SELECT a, b2 FROM m UNION SELECT a2, b FROM m UNION SELECT a2, b2 FROM m)
    SELECT f AS first_value, s AS second_value, ta = 1 AS is_total_first, tb = 1 AS is_total_second, n, users FROM c ANTI JOIN x USING (a, b)""")
def anonymous_cube(t: Tables) -> DataFrame:
    """Lines by quantity and month, with at least five suppliers a published cell."""
    lines = t.lineitem.select(F.col("l_quantity").cast("int").alias("quantity"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"), "l_suppkey")
    return aggregates.anonymous_cube(lines, "quantity", "month", "l_suppkey", 5)


@query("J1_new_key_anti_join", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def new_key_anti_join(t: Tables) -> DataFrame:
    return joins.unseen(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey", "c_name")


@query("J2_incomplete_semi_join", """
    SELECT o_orderkey, o_orderpriority FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount = 0)""")
def incomplete_semi_join(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.incomplete(t.orders, lines, ["o_orderkey"], F.col("l_discount") == 0).select("o_orderkey", "o_orderpriority")


@query("J3_item_detail", """
    SELECT l_orderkey, l_linenumber, o_orderstatus, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE l_quantity > 45""")
def item_detail(t: Tables) -> DataFrame:
    lines = t.lineitem.where("l_quantity > 45")
    joined = lines.join(t.orders, lines.l_orderkey == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name")


@query("J4_claim_detail", """
    SELECT p_partkey, p_name, c_custkey, c_name FROM part, customer WHERE c_custkey = 7 AND p_size = 10""")
def claim_detail(t: Tables) -> DataFrame:
    return joins.with_one(t.part.where("p_size = 10").select("p_partkey", "p_name"), t.customer.select("c_custkey", "c_name"), F.col("c_custkey") == 7)


@query("J5_never_touched", """
    SELECT p_partkey, p_name FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity >= 49) ON l_partkey = p_partkey WHERE l_partkey IS NULL""")
def never_touched(t: Tables) -> DataFrame:
    touched = t.lineitem.where("l_quantity >= 49").withColumnRenamed("l_partkey", "p_partkey")
    return joins.unseen(t.part, touched, ["p_partkey"]).select("p_partkey", "p_name")


@query("J6_retry_errors", """
    SELECT user_id, event_id, c_name FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'error'""")
def retry_errors(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error'").join(t.customer, F.col("user_id") == F.col("c_custkey")).select("user_id", "event_id", "c_name")


@query("J7_left_enrich", """
    SELECT event_id, event_type, c_name FROM events LEFT JOIN customer ON c_custkey = user_id""")
def left_enrich(t: Tables) -> DataFrame:
    return t.events.join(t.customer, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "event_type", "c_name")


@query("J9_case_folded_lookup", """
    SELECT s_suppkey, arg_min(c_custkey, c_custkey) AS c_custkey FROM supplier JOIN customer
    ON lower(replace(s_name, 'Supplier', 'Customer')) = lower(c_name) GROUP BY s_suppkey""")
def case_folded_lookup(t: Tables) -> DataFrame:
    named = t.supplier.withColumn("name", F.replace("s_name", F.lit("Supplier"), F.lit("CUSTOMER")))
    return joins.first_by_name(named, t.customer, "name", "c_name", "s_suppkey", "c_custkey").select("s_suppkey", "c_custkey")


@query("J10_candidate_lookup", """
    WITH c AS (SELECT s_suppkey, k, name FROM (SELECT s_suppkey, [replace(s_name, 'Supplier', 'Customer'), s_name, 'Customer#' || s_suppkey] AS names FROM supplier),
               unnest(names) WITH ORDINALITY AS u(name, k))
    SELECT s_suppkey, min(c_custkey) AS c_custkey FROM c JOIN customer ON c_name = name GROUP BY s_suppkey""")
def candidate_lookup(t: Tables) -> DataFrame:
    names = F.array(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")), F.col("s_name"), F.concat(F.lit("Customer#"), F.col("s_suppkey")))
    return joins.first_of_candidates(t.supplier.withColumn("names", names), "names", t.customer, "c_name", "s_suppkey", "c_custkey")


@query("J11_map_lookup", """
    SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'FR' WHEN 'GERMANY' THEN 'DE' WHEN 'CHINA' THEN 'CN' WHEN 'JAPAN' THEN 'JP' WHEN 'CANADA' THEN 'CA'
           WHEN 'INDIA' THEN 'IN' WHEN 'BRAZIL' THEN 'BR' WHEN 'ARGENTINA' THEN 'AR' WHEN 'EGYPT' THEN 'EG' WHEN 'KENYA' THEN 'KE' WHEN 'MOROCCO' THEN 'MA'
           WHEN 'PERU' THEN 'PE' WHEN 'ROMANIA' THEN 'RO' WHEN 'SAUDI ARABIA' THEN 'SA' WHEN 'VIETNAM' THEN 'VN' WHEN 'INDONESIA' THEN 'ID'
           WHEN 'UNITED KINGDOM' THEN 'GB' WHEN 'UNITED STATES' THEN 'US' END AS country FROM nation""")
def map_lookup(t: Tables) -> DataFrame:
    from corvane.functions import places

    return t.nation.select("n_nationkey", places.country_of_name(F.col("n_name")).alias("country"))


@query("J12_prefix_join", """
    SELECT p_partkey, r.decision FROM part JOIN (VALUES ('Brand#1', 'keep'), ('Brand#2', 'drop'), ('Brand#25', 'special')) AS r(prefix, decision)
    ON starts_with(p_brand, r.prefix)""")
def prefix_join(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("Brand#1", "keep"), ("Brand#2", "drop"), ("Brand#25", "special")], "prefix string, decision string")
    return joins.by_prefix(t.part, rules, "p_brand", "prefix").select("p_partkey", "decision")


@query("J13_cascade_lookup", """
    WITH d AS (SELECT * FROM (VALUES ('type::PROMO', 'confirm', 'promo'), ('brand::Brand#11', 'reject', NULL), ('size::10', 'special', 'ten')) AS v(k, bucket, category)),
    c AS (SELECT p_partkey, rank, k FROM (SELECT p_partkey, ['type::' || split_part(p_type, ' ', 1), 'brand::' || p_brand, 'size::' || p_size] AS ks FROM part),
          unnest(ks) WITH ORDINALITY AS u(k, rank))
    SELECT p.p_partkey, arg_min(d.bucket, rank) AS bucket, first(d.category ORDER BY rank) FILTER (d.k IS NOT NULL) AS category
    FROM part p LEFT JOIN (SELECT p_partkey, rank, c.k FROM c JOIN d USING (k)) m USING (p_partkey) LEFT JOIN d ON d.k = m.k GROUP BY p.p_partkey""")
def cascade_lookup(t: Tables) -> DataFrame:
    decisions = t.spark.createDataFrame(
        [("type::PROMO", "confirm", "promo"), ("brand::Brand#11", "reject", None), ("size::10", "special", "ten")], "key string, bucket string, category string"
    )
    keys = F.array(
        F.concat(F.lit("type::"), F.split_part("p_type", F.lit(" "), F.lit(1))), F.concat(F.lit("brand::"), "p_brand"), F.concat(F.lit("size::"), "p_size")
    )
    return joins.first_decision(t.part.select("p_partkey", keys.alias("keys")), "keys", decisions, ["p_partkey"])


@query("J17_cross_source_keys", """
    SELECT nationkey, count(DISTINCT src) AS n_sources FROM (SELECT s_nationkey AS nationkey, 'supplier' AS src FROM supplier UNION ALL
    SELECT c_nationkey, 'customer' FROM customer) GROUP BY nationkey HAVING count(DISTINCT src) > 1""")
def cross_source_keys(t: Tables) -> DataFrame:
    both = t.supplier.select(F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("src")).unionByName(
        t.customer.select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("src"))
    )
    return joins.in_several_sources(both, "nationkey", "src")


@query("J18_new_disagreements", """
    SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1 EXCEPT SELECT user_id, event_type FROM events WHERE event_id % 2 = 0""")
def new_disagreements(t: Tables) -> DataFrame:
    post, pre = (t.events.where(F.col("event_id") % 2 == k).select("user_id", "event_type") for k in (1, 0))
    return joins.unseen(post.distinct(), pre, ["user_id", "event_type"])


@query("P2_flag_filter", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7 AND s_acctbal > 0")
def flag_filter(t: Tables) -> DataFrame:
    return t.supplier.where("s_nationkey = 7 AND s_acctbal > 0").select("s_suppkey", "s_name")


@query("P3_unprocessed", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts END AS checked FROM events) WHERE checked IS NULL")
def unprocessed(t: Tables) -> DataFrame:
    return filters.unprocessed(t.events.withColumn("checked", F.when(F.col("event_id") % 3 == 0, F.col("ts"))), "checked").select("event_id")


@query("P4_lookback", """
    SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def lookback(t: Tables) -> DataFrame:
    latest = t.events.agg(F.max("ts").alias("now"))
    return t.events.crossJoin(F.broadcast(latest)).where(F.col("ts") > F.col("now") - F.expr("INTERVAL 1 HOUR")).select("event_id", "ts")


@query("P5_non_empty", "SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS body FROM documents) WHERE body <> ''")
def non_empty(t: Tables) -> DataFrame:
    return t.documents.withColumn("body", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text"))).where("body != ''").select("doc_id")


@query("P6_three_valued", """
    SELECT event_id FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'tailor_error: x' WHEN 'view' THEN 'posting_gone' WHEN 'click' THEN 'lease_expired' END AS reason FROM events)
    WHERE reason IS DISTINCT FROM 'posting_gone' AND reason NOT LIKE 'tailor_error:%'""")
def three_valued(t: Tables) -> DataFrame:
    reason = F.when(F.col("event_type") == "error", "tailor_error: x").when(F.col("event_type") == "view", "posting_gone").when(F.col("event_type") == "click", "lease_expired")
    return t.events.withColumn("reason", reason).where(filters.retriable("reason")).select("event_id")


@query("P8_slug_validity", """
    SELECT page_id, s.slug, length(slug) BETWEEN 2 AND 80 AND NOT regexp_matches(slug, '[./ ]') AND slug NOT IN ('api', 'static', 'assets') AS valid
    FROM pages, LATERAL (SELECT coalesce(regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1), '') AS slug) s""")
def slug_validity(t: Tables) -> DataFrame:
    slug = F.coalesce(F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1), F.lit(""))
    return t.pages.select("page_id", slug.alias("slug")).withColumn("valid", filters.valid_slug(F.col("slug"), ["api", "static", "assets"]))


@query("P9_json_project", """
    SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.missing'), '') AS missing, strftime(ts, '%B %Y') AS month FROM events""")
def json_project(t: Tables) -> DataFrame:
    path = lambda p: F.coalesce(F.get_json_object("props", p), F.lit(""))
    return t.events.select("event_id", path("$.k").alias("k"), path("$.missing").alias("missing"), F.date_format("ts", "MMMM yyyy").alias("month"))


@query("P10_block_page", """
    SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 403 ELSE 200 END IN (403, 429) OR regexp_matches(substr(html, 1, 5000), '(?i)captcha|access denied|verify you are a? ?human') AS blocked FROM pages""")
def block_page(t: Tables) -> DataFrame:
    status = F.when(F.col("page_id") % 7 == 0, 403).otherwise(200)
    return t.pages.select("page_id", filters.looks_blocked(F.col("html"), status).alias("blocked"))


@query("P11_liveness", """
    WITH x AS (SELECT page_id, url, (ARRAY[200, 404, 403, 500])[1 + page_id % 4] AS status, CASE WHEN page_id % 5 = 0 THEN url || '?error=true' WHEN page_id % 5 = 1 THEN 'https://h.example/jobs' ELSE url END AS final_url FROM pages)
    SELECT page_id, CASE WHEN status = 404 THEN true WHEN status IN (403, 429) THEN false WHEN contains(final_url, 'error=true') THEN true WHEN final_url = url THEN false
           ELSE NOT regexp_matches(final_url, '/jobs/[^/]+') END AS dead FROM x""")
def liveness(t: Tables) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (200, 404, 403, 500))), (1 + F.col("page_id") % 4).cast("int"))
    final = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("?error=true"))).when(F.col("page_id") % 5 == 1, "https://h.example/jobs").otherwise(F.col("url"))
    return t.pages.select("page_id", filters.listing_dead(status, F.col("url"), final).alias("dead"))


@query("P13_prefix_override", """
    SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'real' WHEN starts_with(url, 'https://') THEN 'real' ELSE 'junk' END AS bucket FROM pages""")
def prefix_override(t: Tables) -> DataFrame:
    bucket = F.when(F.col("page_id") % 3 != 0, "real").otherwise("uncertain")
    return t.pages.select("page_id", filters.override_uncertain(bucket, F.col("url"), [("https://", "real"), ("", "junk")]).alias("bucket"))


@query("T1_priority_topk", """
    SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderdate, o_orderkey LIMIT 50""")
def priority_topk(t: Tables) -> DataFrame:
    first = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    return t.orders.orderBy(first, "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


@query("T2_oldest_batch", "SELECT event_id FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 20")
def oldest_batch(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'view'").orderBy("ts", "event_id").limit(20).select("event_id")


@query("T3_most_common", """
    SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, min(p_partkey) LIMIT 5""")
def most_common(t: Tables) -> DataFrame:
    return aggregates.most_common(t.part, "p_brand", "p_partkey", 5)


@query("T4_by_size", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type")
def by_size(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type")


@query("T5_seeded_order", "SELECT c_custkey FROM customer ORDER BY sha256('11|' || c_custkey), c_custkey LIMIT 25")
def seeded_order(t: Tables) -> DataFrame:
    return filters.seeded_rows(t.customer, "c_custkey", 25, seed=11).select("c_custkey")


@query("T6_rarity_sample", """
    WITH s AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type HAVING count(*) <= 30)
    SELECT p_partkey FROM part JOIN s USING (p_type) ORDER BY n, p_type, p_partkey LIMIT 40""")
def rarity_sample(t: Tables) -> DataFrame:
    return filters.rarest_first(t.part, "p_type", "p_partkey", 30, 40).select("p_partkey")


@query("T7_group_sample", """
    SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY sha256('3|' || source), source LIMIT 4)""")
def group_sample(t: Tables) -> DataFrame:
    return filters.seeded_groups(t.documents, "source", 4, seed=3).select("doc_id", "source")


@query("U1_union_distinct", "SELECT s_nationkey AS nationkey FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(t: Tables) -> DataFrame:
    return t.supplier.selectExpr("s_nationkey AS nationkey").union(t.customer.selectExpr("c_nationkey")).distinct()


@query("U2_union_all", "SELECT s_nationkey AS nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def union_all(t: Tables) -> DataFrame:
    return t.supplier.selectExpr("s_nationkey AS nationkey").unionByName(t.customer.selectExpr("c_nationkey AS nationkey"))


@query("U3_except", "SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def except_(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey").subtract(t.supplier.select("s_nationkey"))


@query("U4_intersect", "SELECT s_nationkey AS nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def intersect(t: Tables) -> DataFrame:
    return t.supplier.selectExpr("s_nationkey AS nationkey").intersect(t.customer.select("c_nationkey"))


@query("U5_distinguishing_term", """
    WITH w AS (SELECT p_brand, p_partkey, unnest(list_distinct(string_split(lower(p_type || ' ' || p_name), ' '))) AS term FROM part WHERE p_size < 45),
    n AS (SELECT p_brand, count(*) AS members FROM part WHERE p_size < 45 GROUP BY p_brand),
    common AS (SELECT p_brand, term FROM w GROUP BY p_brand, term HAVING count(*) * 2 >= (SELECT members FROM n WHERE n.p_brand = w.p_brand)),
    other AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS term FROM part WHERE p_size >= 45)
    SELECT p_brand, term FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(term), term) AS k FROM common
    WHERE term NOT IN (SELECT term FROM other)) WHERE k = 1""")
def distinguishing_term(t: Tables) -> DataFrame:
    words = lambda c: F.split(F.lower(c), " ")
    members = t.part.where("p_size < 45").select("p_brand", words(F.concat_ws(" ", "p_type", "p_name")).alias("terms"))
    others = t.part.where("p_size >= 45").select(words(F.col("p_name")).alias("terms"))
    return aggregates.distinguishing_term(members, "p_brand", "terms", others, share=0.5)


@query("W1_recent_topn", """
    SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10""")
def recent_topn(t: Tables) -> DataFrame:
    return windows.top_n(t.events, ["event_type"], [F.desc("ts"), F.desc("event_id")], 10).select("event_type", "event_id")


@query("W2_queue_claim", """
    SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O') WHERE k = 1""")
def queue_claim(t: Tables) -> DataFrame:
    return windows.top_n(t.orders.where("o_orderstatus = 'O'"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 1).select("o_custkey", "o_orderkey")


@query("W3_latest_open", """
    SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type <> 'purchase') WHERE k = 1""")
def latest_open(t: Tables) -> DataFrame:
    return windows.top_n(t.events.where("event_type != 'purchase'"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 1).select("user_id", "event_id")


@query("W4_failure_streaks", """
    WITH i AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
    s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
    SELECT event_id, user_id, streak::BIGINT AS streak, max(CASE WHEN streak >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 AS deactivated FROM s""")
def failure_streaks(t: Tables) -> DataFrame:
    order = [F.col("ts"), F.col("event_id")]
    found = windows.streaks(t.events, ["user_id"], order, F.col("event_type") == "error", F.col("event_type") == "purchase")
    return found.withColumn("deactivated", windows.tripped(found, ["user_id"], order, "streak", 2)).select("event_id", "user_id", "streak", "deactivated")


@query("W5_circuit_breaker", """
    WITH i AS (SELECT *, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER w AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT *, sum(CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END) OVER w AS block_streak, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS page_block_streak
          FROM i WINDOW w AS (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, max(CASE WHEN page_block_streak >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 AS page_tripped FROM s)
    SELECT event_id, block_streak::BIGINT AS block_streak, page_block_streak::BIGINT AS page_block_streak, page_tripped, page_tripped OR block_streak >= 10 AS should_halt, NOT page_tripped AND block_streak >= 4 AS early_checkpoint FROM p""")
def circuit_breaker(t: Tables) -> DataFrame:
    found = windows.breaker(
        t.events.withColumn("run", F.col("user_id")), ["run"], [F.col("ts"), F.col("event_id")], "event_type", F.col("event_type") == "error", ["error", "click"], ["purchase", "signup"], checkpoint_every=5
    )
    return found.select("event_id", "block_streak", "page_block_streak", "page_tripped", "should_halt", "early_checkpoint")


@query("W6_occurrence_index", """
    SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) - 1 AS occurrence FROM lineitem""")
def occurrence_index(t: Tables) -> DataFrame:
    return windows.occurrence(t.lineitem, ["l_orderkey", "l_returnflag"], [F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", "occurrence")


@query("W7_first_seen", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_seen(t: Tables) -> DataFrame:
    return windows.top_n(t.events, ["user_id", "event_type"], [F.col("event_id")], 1).select("user_id", "event_type", "event_id")


@query("W8_content_versions", """
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS spot FROM orders),
    g AS (SELECT *, min(spot) OVER (PARTITION BY o_custkey, o_orderpriority) AS first FROM f),
    v AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY first) AS version FROM g)
    SELECT o_orderkey, version, version = max(version) OVER (PARTITION BY o_custkey) AS active FROM v""")
def content_versions(t: Tables) -> DataFrame:
    found = windows.content_versions(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderpriority")
    return found.select("o_orderkey", "version", "active")


@query("W9_new_per_batch", """
    SELECT batch, count(*) AS n_new FROM (SELECT user_id, min(event_id // 100) AS batch FROM events GROUP BY user_id) GROUP BY batch""")
def new_per_batch(t: Tables) -> DataFrame:
    return windows.new_per_batch(t.events.withColumn("batch", F.floor(F.col("event_id") / 100)), "user_id", "batch")


@query("W10_half_shares", """
    WITH h AS (SELECT user_id, event_type, ntile(2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS half FROM events)
    SELECT user_id, avg(CASE WHEN half = 1 THEN (event_type = 'error')::INT::DOUBLE END) AS share_1, avg(CASE WHEN half = 2 THEN (event_type = 'error')::INT::DOUBLE END) AS share_2 FROM h GROUP BY user_id""")
def half_shares(t: Tables) -> DataFrame:
    return windows.half_shares(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error")


@query("ST3_payload_change", """
    WITH h AS (SELECT conv_id, turn, sha256(text) AS payload_hash FROM conversations)
    SELECT conv_id, turn, payload_hash, lag(payload_hash) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM payload_hash AS changed FROM h""")
def payload_change(t: Tables) -> DataFrame:
    """A conversation is the record, its turns are its payloads."""
    return windows.changed_payloads(t.conversations, ["conv_id"], [F.col("turn")], F.col("text")).select("conv_id", "turn", "payload_hash", "changed")


@query("X_time_in_stage", """
    SELECT user_id, event_id, event_type, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS seconds_since FROM events""")
def time_in_stage(t: Tables) -> DataFrame:
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    seconds = F.timestamp_diff("SECOND", F.date_trunc("second", before), F.date_trunc("second", "ts"))
    return t.events.select("user_id", "event_id", "event_type", seconds.alias("seconds_since"))
