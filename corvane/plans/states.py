"""State writers on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import merge
from corvane.plans.base import Tables, query


@query("M1_first_wins_insert", """
    WITH a AS (SELECT doc_id, source, 0 AS origin FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, 'polled' AS source, 1 AS origin FROM documents WHERE doc_id % 2 = 0)
    SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY origin) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE k = 1""")
def first_wins_insert(t: Tables) -> DataFrame:
    held = t.documents.where(F.col("doc_id") % 3 != 0).select("doc_id", "source")
    new = t.documents.where(F.col("doc_id") % 2 == 0).select("doc_id", F.lit("polled").alias("source"))
    return merge.insert_if_absent(held, new, ["doc_id"], [F.col("source")])


@query("M2_fill_empty", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN '' ELSE text END AS text FROM documents")
def fill_empty(t: Tables) -> DataFrame:
    held = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("text"))
    new = t.documents.where(F.col("doc_id") % 2 == 0).select("doc_id", "text")
    return merge.fill_empty(held, new, ["doc_id"], ["text"])


@query("M3_fill_empty_json", """
    SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id % 3 <> 0 THEN props WHEN event_id % 4 = 0 THEN '{}' WHEN event_id % 4 = 1 AND event_id % 3 <> 0 THEN props
           WHEN event_id % 4 = 1 THEN NULL ELSE '{"old": 1}' END AS props FROM events""")
def fill_empty_json(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 4
    held = t.events.select("event_id", F.when(kind == 0, "{}").when(kind == 1, F.lit(None)).otherwise('{"old": 1}').alias("props"))
    new = t.events.where(F.col("event_id") % 3 != 0).select("event_id", "props")
    return merge.fill_empty_json(held, new, ["event_id"], "props")


@query("M4_upsert_last_wins", """
    SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def upsert_last_wins(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "ts", "event_id")
    latest = [F.desc("ts"), F.desc("event_id")]
    held = merge.first_of(rows.where("event_id % 2 = 0"), ["user_id"], latest)
    newer = rows.join(held.selectExpr("user_id", "ts AS held_ts", "event_id AS held_id"), "user_id", "left").where(
        "held_ts IS NULL OR ts > held_ts OR (ts = held_ts AND event_id > held_id)"
    )
    return merge.upsert(held, newer.select(rows.columns), ["user_id"], latest).select("user_id", "event_type", "ts")


@query("M4_sources_united", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || ',mirror' ELSE source END AS sources FROM documents""")
def sources_united(t: Tables) -> DataFrame:
    held = t.documents.select("doc_id", F.array("source").alias("sources"))
    new = t.documents.where("doc_id % 2 = 0").select("doc_id", F.array(F.lit("mirror")).alias("sources"))
    found = merge.upsert_merging(held, new, ["doc_id"], [F.col("doc_id")], "sources")
    return found.select("doc_id", F.array_join("sources", ",").alias("sources"))


@query("M5_insert_or_get", """
    SELECT c_name, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE 'new-' || c_name END AS company_id FROM customer""")
def insert_or_get(t: Tables) -> DataFrame:
    held = t.customer.where("c_custkey % 2 = 0").select("c_name", F.col("c_custkey").cast("string").alias("company_id"))
    return merge.insert_or_get(held, t.customer.select("c_name"), ["c_name"], "company_id", F.concat(F.lit("new-"), "c_name"))


@query("M8_append_valid", "SELECT event_id, event_type FROM events")
def append_valid(t: Tables) -> DataFrame:
    log = t.events.where("event_id % 2 = 0").select("event_id", "event_type")
    new = t.events.where("event_id % 2 = 1").select("event_id", "event_type")
    return merge.append_valid(log, new, "event_type", ["signup", "view", "purchase", "error", "click"])


@query("M9_bulk_stamp", """
    SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48) THEN TIMESTAMP '2024-01-15 12:00:00' END AS checked_at FROM orders""")
def bulk_stamp(t: Tables) -> DataFrame:
    held = t.orders.select("o_orderkey", F.lit(None).cast("timestamp").alias("checked_at"))
    seen = t.lineitem.where("l_quantity > 48").selectExpr("l_orderkey AS o_orderkey")
    return merge.stamp(held, seen, ["o_orderkey"], "checked_at", F.lit("2024-01-15 12:00:00").cast("timestamp"))


@query("M10_guarded_write_back", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND lang <> 'en' THEN '' ELSE text END AS text, lang FROM documents")
def guarded_write_back(t: Tables) -> DataFrame:
    held = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("text"), "lang")
    return merge.fill_empty(held, t.documents.select("doc_id", "text"), ["doc_id"], ["text"], F.col("lang") == "en")


@query("M11_json_merge", """
    SELECT event_id, '{"country":"DE","k":' || (CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE '0' END) || '}' AS merged FROM events""")
def json_merge(t: Tables) -> DataFrame:
    change = F.when(F.col("event_id") % 2 == 0, '{"country": "DE"}').otherwise('{"k": 0, "country": "DE"}')
    return t.events.select("event_id", merge.json_merge(F.col("props"), change).alias("merged"))


@query("M12_json_promotion", """
    SELECT event_id, json_extract_string(props, '$.k')::INT AS k, '{}' AS rest, strptime('Sep 2024', '%b %Y')::DATE AS month FROM events""")
def json_promotion(t: Tables) -> DataFrame:
    number = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.select("event_id", number.alias("k"), merge.json_without(F.col("props"), "k").alias("rest"), F.to_date(F.lit("Sep 2024"), "MMM yyyy").alias("month"))


@query("M13_append_missing", """
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_brand ELSE p_brand || ',mapped' END AS categories FROM part""")
def append_missing(t: Tables) -> DataFrame:
    value = F.when(F.col("p_size") % 3 == 0, F.lit(None)).when(F.col("p_size") % 3 == 1, F.col("p_brand")).otherwise("mapped")
    return t.part.select("p_partkey", F.array_join(merge.append_missing(F.array("p_brand"), value), ",").alias("categories"))


@query("M14_ttl_delete", """
    SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus IN ('F', 'P') AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 90 DAY)""")
def ttl_delete(t: Tables) -> DataFrame:
    old = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp") - F.expr("INTERVAL 90 DAY")
    return merge.without(t.orders, F.col("o_orderstatus").isin("F", "P") & old).select("o_orderkey")


@query("M15_domain_repair", "SELECT event_id FROM events WHERE event_type NOT IN ('error', 'click')")
def domain_repair(t: Tables) -> DataFrame:
    return merge.without(t.events, F.col("event_type").isin("error", "click")).select("event_id")


@query("M16_status_remap", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'submitted' WHEN 'P' THEN 'preparing' ELSE o_orderstatus END AS status FROM orders")
def status_remap(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", merge.remap(F.col("o_orderstatus"), {"F": "submitted", "P": "preparing"}).alias("status"))


@query("M17_latest_stage", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_stage(t: Tables) -> DataFrame:
    return merge.latest_by(t.events, "user_id", "event_type", "event_id")


@query("M6_M7_failure_counter", """
    WITH i AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
    s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
    SELECT user_id, arg_max(streak, (ts, event_id))::BIGINT AS failures, max(streak) < 5 AS is_active FROM s GROUP BY user_id""")
def failure_counter(t: Tables) -> DataFrame:
    from corvane.operators import windows

    found = windows.streaks(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error", F.col("event_type") == "purchase")
    return found.groupBy("user_id").agg(F.max_by("streak", F.struct("ts", "event_id")).alias("failures"), (F.max("streak") < 5).alias("is_active"))


@query("M21_guarded_choice", "SELECT n_nationkey, n_name FROM nation")
def guarded_choice(t: Tables) -> DataFrame:
    from corvane.sources.readers import first_that_has_rows

    return first_that_has_rows(t.nation.where("n_nationkey < 0"), t.nation).select("n_nationkey", "n_name")


@query("X_snapshot_diff", """
    SELECT event_id, 'k' AS entry, json_extract_string(props, '$.k') AS before, '0' AS after FROM events WHERE json_extract_string(props, '$.k') <> '0'""")
def snapshot_diff(t: Tables) -> DataFrame:
    from corvane.operators.evaluate import map_diff

    rows = t.events.select("event_id", F.from_json("props", "map<string,string>").alias("old"), F.create_map(F.lit("k"), F.lit("0")).alias("new"))
    return map_diff(rows, ["event_id"], "old", "new")
