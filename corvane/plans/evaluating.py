"""Evaluation of classifiers on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import evaluate
from corvane.plans.base import Tables, query

_KEYED = """
    WITH r AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'reject' WHEN 2 THEN 'special' ELSE 'confirm' END AS bucket,
        CASE WHEN p_size % 7 = 0 THEN 'UNSUPPORTED' ELSE split_part(p_type, ' ', 1) END AS truth, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'PROMO' ELSE split_part(p_type, ' ', 1) END AS pred FROM part),
    o AS (SELECT *, CASE WHEN bucket IN ('reject', 'special') THEN 'excluded_' || bucket WHEN bucket IS NULL AND pred IS NULL THEN 'both_unknown' WHEN bucket IS NULL THEN 'beat_key' WHEN truth = 'UNSUPPORTED' THEN 'unsupported'
        WHEN pred IS NULL THEN 'predicted_unknown' WHEN truth = pred THEN 'match' ELSE 'mismatch' END AS outcome FROM r)"""


def keyed(t: Tables) -> DataFrame:
    size, kind = F.col("p_size"), F.split_part("p_type", F.lit(" "), F.lit(1))
    rows = t.part.select(
        "p_partkey", F.when(size % 5 == 0, F.lit(None)).when(size % 5 == 1, "reject").when(size % 5 == 2, "special").otherwise("confirm").alias("bucket"),
        F.when(size % 7 == 0, evaluate.UNSUPPORTED).otherwise(kind).alias("truth"), F.when(size % 4 == 0, F.lit(None)).when(size % 3 == 0, "PROMO").otherwise(kind).alias("pred"),
    )
    return rows.withColumn("outcome", evaluate.replay_outcome(F.col("bucket"), F.col("truth"), F.col("pred")))


@query("E1_replay_outcomes", _KEYED + " SELECT outcome, count(*) AS n FROM o GROUP BY outcome")
def replay_outcomes(t: Tables) -> DataFrame:
    return keyed(t).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("A9_category_rates", _KEYED + """,
    c AS (SELECT truth, count(*) FILTER (outcome = 'match') AS match, count(*) FILTER (outcome = 'mismatch') AS mismatch, count(*) FILTER (outcome = 'predicted_unknown') AS predicted_unknown FROM o GROUP BY truth)
    SELECT *, match + mismatch + predicted_unknown AS scored, CASE WHEN match + mismatch + predicted_unknown > 0 THEN match / (match + mismatch + predicted_unknown)::DOUBLE END AS coverage,
    CASE WHEN match + mismatch > 0 THEN match / (match + mismatch)::DOUBLE END AS precision FROM c""")
def category_rates(t: Tables) -> DataFrame:
    return evaluate.replay_rates(keyed(t), "outcome", "truth")


@query("E1_confusion_pairs", _KEYED + " SELECT truth, pred, count(*) AS n FROM o WHERE outcome = 'mismatch' GROUP BY truth, pred ORDER BY n DESC, truth, pred LIMIT 10")
def confusion_pairs(t: Tables) -> DataFrame:
    return evaluate.confusion(keyed(t).where("outcome = 'mismatch'"), "truth", "pred", 10)


@query("E1_labels_replay", """
    SELECT quality, CASE WHEN contains(text, '|') OR contains(text, '!!') THEN 0 ELSE 1 END AS pred, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def labels_replay(t: Tables) -> DataFrame:
    pred = F.when(F.contains("text", F.lit("|")) | F.contains("text", F.lit("!!")), 0).otherwise(1)
    return evaluate.confusion(t.labels.join(t.documents, "doc_id").withColumn("pred", pred), "quality", "pred")


@query("A10_E4_set_accuracy", """
    WITH s AS (SELECT string_split(p_type, ' ') AS truth, CASE p_size % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN string_split(p_type, ' ') WHEN 2 THEN [split_part(p_type, ' ', 1), 'x'] ELSE ['x'] END AS pred FROM part)
    SELECT count(*) AS n, count(*) FILTER (list_sort(list_distinct(truth)) = list_sort(list_distinct(pred))) AS exact, count(*) FILTER (len(list_intersect(truth, pred)) > 0) AS overlap,
    count(*) FILTER (len(pred) > 0 AND len(list_intersect(truth, pred)) = 0) AS wrong, count(*) FILTER (len(pred) = 0) AS abstained FROM s""")
def set_accuracy(t: Tables) -> DataFrame:
    words = F.split("p_type", " ")
    kind = F.col("p_size") % 4
    pred = F.when(kind == 0, F.array().cast("array<string>")).when(kind == 1, words).when(kind == 2, F.array(F.get(words, F.lit(0)), F.lit("x"))).otherwise(F.array(F.lit("x")))
    return evaluate.set_accuracy(t.part.select(words.alias("truth"), pred.alias("pred")), "truth", "pred")


@query("A11_held_out_coverage", """
    SELECT count(*) AS n, count(*) FILTER (p_size > 10) AS covered FROM part
    WHERE p_brand IN (SELECT p_brand FROM (SELECT DISTINCT p_brand FROM part) ORDER BY sha256('42|' || p_brand), p_brand LIMIT 5)""")
def held_out_coverage(t: Tables) -> DataFrame:
    return evaluate.held_out_coverage(t.part, "p_brand", F.col("p_size") > 10, 5, seed=42)


@query("E2_gate", """
    SELECT (SELECT count(*) FROM nation WHERE n_nationkey > 90) AS failed, (SELECT count(*) FROM region WHERE r_regionkey > 90) AS disagreeing, true AS passed""")
def gate(t: Tables) -> DataFrame:
    return evaluate.gate(t.nation.where("n_nationkey > 90"), t.region.where("r_regionkey > 90"), F.lit(0.90), F.lit(0.895))


@query("E3_completion", """
    WITH c AS (SELECT count(*) FILTER (user_id % 2 = 0) >= 500 AND count(*) FILTER (user_id % 2 = 1) >= 500 AS volume, count(*) FILTER (event_type = 'error') < 0.5 * count(*) AS clean, count(DISTINCT event_type) >= 5 AS variety FROM events)
    SELECT *, volume AND clean AND variety AS complete FROM c""")
def completion(t: Tables) -> DataFrame:
    even, odd = (F.count(F.when(F.col("user_id") % 2 == k, 1)) for k in (0, 1))
    conditions = {"volume": (even >= 500) & (odd >= 500), "clean": F.count(F.when(F.col("event_type") == "error", 1)) < 0.5 * F.count(F.lit(1)), "variety": F.countDistinct("event_type") >= 5}
    return evaluate.completion(t.events, conditions)


@query("X_correction_chains", """
    SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id - 1 FROM events WHERE event_type = 'error')""")
def correction_chains(t: Tables) -> DataFrame:
    corrected = t.events.where("event_type = 'error'").selectExpr("event_id - 1 AS event_id")
    return t.events.join(corrected, "event_id", "left_anti").select("event_id")


@query("X_fill_accuracy", """
    SELECT user_id, avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END)::DOUBLE AS share_unedited FROM events GROUP BY user_id""")
def fill_accuracy(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)).alias("share_unedited"))


@query("X_checkpoint_chain", """
    WITH f AS (SELECT *, user_id % 11 AS slot, CASE WHEN event_type = 'purchase' THEN 'FILL_FAILED' ELSE 'CLASSIFICATION_NO_MATCH' END AS reason FROM events WHERE event_type <> 'view' AND event_id > 40),
    p AS (SELECT greatest(3, ceil(0.02 * count(*))) AS bar FROM events),
    c AS (SELECT event_type, slot, count(*) AS n, arg_min(reason, event_id) AS reason, min(event_id) AS first FROM f GROUP BY ALL HAVING count(*) >= (SELECT bar FROM p)),
    r AS (SELECT *, CASE WHEN reason = 'FILL_FAILED' THEN 'no_generalized_fix' WHEN first % 5 = 0 THEN 'needs_human_decision' WHEN first % 7 = 0 THEN 'no_generalized_fix' WHEN first % 3 = 0 THEN 'needs_human_decision' ELSE 'proposed_fix' END AS route FROM c),
    k AS (SELECT *, route = 'proposed_fix' AND slot % 4 <> 1 AS clean FROM r),
    d AS (SELECT *, CASE WHEN clean AND row_number() OVER (PARTITION BY clean ORDER BY n DESC, event_type, slot) <= 3 THEN 'applied' WHEN route = 'no_generalized_fix' THEN 'none' ELSE 'waits' END AS decision FROM k)
    SELECT event_type, slot, n, route, decision, bool_or(decision = 'waits') OVER () AS halted FROM d""")
def checkpoint_chain(t: Tables) -> DataFrame:
    """Events but views stand for failures, kind and slot for the fingerprint; the gate refuses some slots."""
    own = t.events.where("event_type != 'view'").select(
        "event_id", "event_type", (F.col("user_id") % 11).alias("slot"), F.when(F.col("event_type") == "purchase", "FILL_FAILED").otherwise("CLASSIFICATION_NO_MATCH").alias("reason"),
        F.when(F.col("event_id") % 5 != 0, "email").alias("category"), F.when(F.col("event_id") % 7 != 0, "work").alias("term"), (F.col("event_id") % 3 != 0).alias("guarded"),
    )
    return evaluate.checkpoint(own, "event_id", 40, ["event_type", "slot"], t.events.count(), F.col("slot") % 4 != 1)
