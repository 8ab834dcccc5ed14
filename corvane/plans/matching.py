"""Matching, clustering and classification on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import classify, cluster, joins, matching
from corvane.plans.base import Tables, query

#: Suppliers stand for jobs, customers for users; keys decide what is stated and what isn't.
_PAIRS = """
    WITH j AS (SELECT s_suppkey AS job, [['sales', 'data'], ['data'], ['design'], ['sales']][1 + s_suppkey % 4] AS cats, (ARRAY['Unknown', 'Remote', 'On-Site', 'Hybrid'])[1 + s_suppkey % 4] AS model,
        CASE s_suppkey % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' ELSE 'Not Sure' END AS visa, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 5 END AS years_min,
        'city ' || (s_nationkey % 5) || ', land' AS place, 'co' || (s_suppkey % 7) AS slug FROM supplier),
    u AS (SELECT c_custkey AS usr, [['sales'], ['data', 'design'], ['legal'], ['design', 'sales', 'data']][1 + c_custkey % 4] AS cats, [['Remote', 'Hybrid'], ['On-Site'], ['Remote', 'On-Site', 'Hybrid']][1 + c_custkey % 3] AS models,
        c_custkey % 6 = 0 AS needs, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 4 END AS years, CASE WHEN c_custkey % 5 = 0 THEN []::VARCHAR[] ELSE ['City ' || (c_nationkey % 5)] END AS places, ['co' || (c_custkey % 9)] AS black FROM customer),
    m AS (SELECT job, usr, slug FROM j, u WHERE len(list_intersect(j.cats, u.cats)) > 0 AND (model = 'Unknown' OR list_contains(models, model)) AND NOT (needs AND visa = 'No')
        AND (years_min IS NULL OR years IS NULL OR years >= years_min) AND (model IN ('Remote', 'Unknown') OR len(places) = 0 OR len(list_filter(places, lambda p: contains(lower(place), lower(p)))) > 0)
        AND NOT list_contains(black, slug))"""


def jobs(t: Tables) -> DataFrame:
    return t.supplier.selectExpr(
        "s_suppkey AS job", "element_at(array(array('sales', 'data'), array('data'), array('design'), array('sales')), cast(1 + s_suppkey % 4 AS int)) AS categories",
        "element_at(array('Unknown', 'Remote', 'On-Site', 'Hybrid'), cast(1 + s_suppkey % 4 AS int)) AS work_model",
        "CASE s_suppkey % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' ELSE 'Not Sure' END AS h1b_sponsored", "CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 5 END AS years_min",
        "concat('city ', s_nationkey % 5, ', land') AS location", "concat('co', s_suppkey % 7) AS company_slug",
    )


def users(t: Tables) -> DataFrame:
    return t.customer.selectExpr(
        "c_custkey AS user", "element_at(array(array('sales'), array('data', 'design'), array('legal'), array('design', 'sales', 'data')), cast(1 + c_custkey % 4 AS int)) AS wanted_categories",
        "element_at(array(array('Remote', 'Hybrid'), array('On-Site'), array('Remote', 'On-Site', 'Hybrid')), cast(1 + c_custkey % 3 AS int)) AS work_models",
        "c_custkey % 6 = 0 AS needs_sponsorship", "CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 4 END AS years",
        "CASE WHEN c_custkey % 5 = 0 THEN cast(array() AS array<string>) ELSE array(concat('City ', c_nationkey % 5)) END AS locations",
        "array(concat('co', c_custkey % 9)) AS blacklisted", "array(concat('co', c_custkey % 2)) AS excluded",
    )


@query("J8_hard_filter_match", _PAIRS + " SELECT job, usr AS user, CASE WHEN slug = 'co' || (usr % 2) THEN 'notified' ELSE 'matched' END AS route FROM m")
def hard_filter_match(t: Tables) -> DataFrame:
    """Jobs of the same facts are matched as one, and so are users; what matches is a cross product of their keys."""
    one = lambda rows, facts, key: matching.alike(rows, facts, key).withColumnRenamed("keys", key)
    pairs = matching.match_alike(one(jobs(t), matching.JOB_FACTS, "job"), one(users(t), [*matching.USER_FACTS, "excluded"], "user"))
    routed = matching.routed(pairs.select("j.job", "u.user", "j.company_slug", "u.excluded"), "company_slug", "excluded")
    return routed.select(F.explode("job").alias("job"), "user", "route").select("job", F.explode("user").alias("user"), "route")


@query("V1_V2_cosine_score", """
    WITH a AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT min(vec_id) AS first, label FROM a GROUP BY label),
    s AS (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS c FROM a JOIN p USING (label) JOIN a q ON q.vec_id = p.first)
    SELECT vec_id, round_even(greatest(0, c) * 100, 0)::INT AS score, round_even(round_even(greatest(0, c) * 100, 0) / 100, 4) AS probability, round_even(greatest(0, c) * 100, 0) >= 80 AS tailoring_eligible
    FROM s WHERE round_even(greatest(0, c) * 100, 0) >= 50""")
def cosine_score(t: Tables) -> DataFrame:
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("profile"))
    rows = t.embeddings.join(first, "label").select("vec_id", matching.relevance(matching.cosine(F.col("embedding"), F.col("profile"))).alias("score"))
    return matching.graded(rows)


@query("V3_jaccard", """
    WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS ws FROM conversations),
    p AS (SELECT a.conv_id, a.ws AS x, b.ws AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1)
    SELECT conv_id, len(list_intersect(x, y)) / greatest(len(list_distinct(list_concat(x, y))), 1)::DOUBLE AS score FROM p""")
def jaccard(t: Tables) -> DataFrame:
    turn = lambda k: t.conversations.where(F.col("turn") == k).select("conv_id", matching.tokens(F.col("text")).alias(f"w{k}"))
    return turn(0).join(turn(1), "conv_id").select("conv_id", matching.jaccard(F.col("w0"), F.col("w1")).alias("score"))


@query("V4_excluded_split", _PAIRS + " SELECT CASE WHEN slug = 'co' || (usr % 2) THEN 'notified' ELSE 'matched' END AS route, count(*) AS n FROM m GROUP BY 1")
def excluded_split(t: Tables) -> DataFrame:
    """Counted without making the pairs, from how many jobs and users have the same facts."""
    pairs = matching.match_alike(matching.alike(jobs(t), matching.JOB_FACTS), matching.alike(users(t), [*matching.USER_FACTS, "excluded"]))
    routed = matching.routed(pairs.select("j.company_slug", "u.excluded", (F.col("j.n") * F.col("u.n")).alias("n")), "company_slug", "excluded")
    return routed.groupBy("route").agg(F.sum("n").alias("n"))


@query("J14_jaccard_best_match", """
    WITH l AS (SELECT p_partkey AS left_key, list_distinct(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) AS ts FROM part),
    r AS (SELECT p_partkey AS right_key, list_distinct(string_split(lower(p_name || ' ' || p_type || ' Brand#' || (p_size % 25 + 1)), ' ')) AS us FROM part),
    k AS (SELECT left_key, right_key, count(*) AS k FROM (SELECT left_key, unnest(ts) AS w FROM l) JOIN (SELECT right_key, unnest(us) AS w FROM r) USING (w) GROUP BY ALL),
    s AS (SELECT left_key, right_key, k / (len(ts) + len(us) - k)::DOUBLE AS score FROM k JOIN l USING (left_key) JOIN r USING (right_key))
    SELECT left_key, right_key, score FROM (SELECT *, row_number() OVER (PARTITION BY left_key ORDER BY score DESC, right_key) AS n FROM s WHERE score >= 0.6) WHERE n = 1""")
def jaccard_best_match(t: Tables) -> DataFrame:
    """All parts by name, type and brand against all parts by name, type and a brand made from the size."""
    rows = lambda key, name, *columns: t.part.select(F.col("p_partkey").alias(key), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", *columns)), " ").alias(name))
    right = rows("right_key", "us", F.concat(F.lit("Brand#"), F.col("p_size") % 25 + 1))
    return joins.best_similar(rows("left_key", "ts", "p_brand"), right, "left_key", "right_key", "ts", "us", 0.6)


@query("J14_documents_best_match", """
    WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS ts FROM documents),
    i AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS us FROM benchmark),
    k AS (SELECT doc_id, item_id, count(*) AS k FROM (SELECT doc_id, unnest(ts) AS w FROM d) JOIN (SELECT item_id, unnest(us) AS w FROM i) USING (w) GROUP BY ALL),
    s AS (SELECT doc_id, item_id, k / (len(ts) + len(us) - k)::DOUBLE AS score FROM k JOIN d USING (doc_id) JOIN i USING (item_id))
    SELECT doc_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS n FROM s WHERE score >= 0.3) WHERE n = 1""")
def documents_best_match(t: Tables) -> DataFrame:
    """All documents against all benchmark items."""
    words = lambda df, key, name: df.select(F.col(key), matching.tokens(F.col("text")).alias(name))
    return joins.best_similar(words(t.documents, "doc_id", "ts"), words(t.benchmark, "item_id", "us"), "doc_id", "item_id", "ts", "us", 0.3)


@query("J15_paired_top5", """
    WITH g AS (SELECT DISTINCT o_orderpriority, nullif(month(o_orderdate), 12) AS cat FROM orders WHERE o_orderstatus = 'F'),
    e AS (SELECT o_orderpriority, o_orderkey, month(o_orderdate) AS m FROM orders WHERE o_orderstatus <> 'F')
    SELECT o_orderpriority, cat AS wanted, o_orderkey FROM (SELECT g.*, e.o_orderkey, row_number() OVER (PARTITION BY g.o_orderpriority, g.cat ORDER BY e.o_orderkey) AS k
    FROM g JOIN e USING (o_orderpriority) WHERE g.cat IS NULL OR g.cat = e.m) WHERE k <= 5""")
def paired_top5(t: Tables) -> DataFrame:
    """Orders of status F ask, all others are the examples; the month is the category, December not stated."""
    groups = t.orders.where("o_orderstatus = 'F'").selectExpr("o_orderpriority", "nullif(month(o_orderdate), 12) AS month").distinct()
    examples = t.orders.where("o_orderstatus <> 'F'").selectExpr("o_orderpriority", "month(o_orderdate) AS month", "o_orderkey")
    found = joins.paired_examples(groups, examples, ["o_orderpriority"], "month", "o_orderkey")
    return found.select("o_orderpriority", F.col("__category").alias("wanted"), "o_orderkey")


@query("J16_longest_contained", """
    WITH e(key, answer, n) AS (VALUES ('steel', 'metal', 1), ('brushed', 'finish', 2), ('economy', 'cheap', 3), ('burnished', 'shine', 4), ('plated', 'coat', 5), ('polished', 'gloss', 6))
    SELECT p_partkey, key, answer FROM (SELECT p_partkey, e.*, row_number() OVER (PARTITION BY p_partkey ORDER BY length(key) DESC, n) AS k FROM part JOIN e ON contains(lower(p_type), key) WHERE length(key) >= 6) WHERE k = 1""")
def longest_contained(t: Tables) -> DataFrame:
    entries = t.spark.createDataFrame(
        [("steel", "metal", 1), ("brushed", "finish", 2), ("economy", "cheap", 3), ("burnished", "shine", 4), ("plated", "coat", 5), ("polished", "gloss", 6)], "key string, answer string, n int"
    )
    return joins.longest_contained(t.part, "p_type", entries, "key", "n", ["p_partkey"])


_CASCADE = """
    WITH d AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN source || lang END AS k1, CASE WHEN n_chars % 3 = 1 OR doc_id % 50 = 0 THEN 'n' || n_chars END AS k2, lang AS k3 FROM documents)"""


def _cascade_keys() -> list:
    return [
        ("exact", F.when(F.col("n_chars") % 3 == 0, F.concat("source", "lang"))), ("size", F.when((F.col("n_chars") % 3 == 1) | (F.col("doc_id") % 50 == 0), F.concat(F.lit("n"), "n_chars"))), ("lang", F.col("lang"))
    ]


@query("C2_cascade_cluster", _CASCADE + """,
    a AS (SELECT *, CASE WHEN k1 IS NOT NULL AND count(*) OVER (PARTITION BY k1) >= 2 THEN k1 END AS c1 FROM d),
    b AS (SELECT *, CASE WHEN c1 IS NULL AND k2 IS NOT NULL AND count(*) FILTER (c1 IS NULL) OVER (PARTITION BY k2) >= 2 THEN k2 END AS c2 FROM a),
    c AS (SELECT *, CASE WHEN c1 IS NULL AND c2 IS NULL AND count(*) FILTER (c1 IS NULL AND c2 IS NULL) OVER (PARTITION BY k3) >= 2 THEN k3 END AS c3 FROM b)
    SELECT doc_id, CASE WHEN c1 IS NOT NULL THEN 'exact' WHEN c2 IS NOT NULL THEN 'size' WHEN c3 IS NOT NULL THEN 'lang' END AS rule, coalesce(c1, c2, c3) AS cluster_key FROM c""")
def cascade_cluster(t: Tables) -> DataFrame:
    return cluster.cascade(t.documents.select("doc_id", "n_chars", "source", "lang"), _cascade_keys()).select("doc_id", "rule", "cluster_key")


@query("C3_stateless_key", _CASCADE + """
    SELECT doc_id, CASE WHEN k1 IS NOT NULL THEN 'exact' WHEN k2 IS NOT NULL THEN 'size' ELSE 'lang' END AS rule, coalesce(k1, k2, k3) AS cluster_key FROM d""")
def stateless_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", cluster.stateless_key(_cascade_keys()).alias("k")).select("doc_id", "k.rule", "k.cluster_key")


@query("C10_merged_fingerprints", """
    SELECT n_nationkey, CASE WHEN n_regionkey = 0 AND n_nationkey % 2 = 0 THEN (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 0 AND n_nationkey % 2 = 0) ELSE n_nationkey END AS root FROM nation""")
def merged_fingerprints(t: Tables) -> DataFrame:
    alike = (F.col("n_regionkey") == 0) & (F.col("n_nationkey") % 2 == 0)
    labels = F.when(alike, F.array(F.lit("Are you authorized to work"))).otherwise(F.array(F.concat(F.lit("q "), "n_name")))
    groups = t.nation.select("n_nationkey", "n_regionkey", F.lit("").alias("id_pattern"), labels.alias("labels"))
    from corvane.sources.sinks import ensure_checkpoints

    ensure_checkpoints(t.spark)
    return cluster.merged_fingerprints(groups, "n_nationkey", ["n_regionkey"], "id_pattern", "labels")


@query("A13_A14_fingerprint_threshold", """
    WITH g AS (SELECT event_type, user_id % 7 AS bucket, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT greatest(3, ceil(0.02 * count(*)))::BIGINT AS threshold FROM events)
    SELECT event_type, bucket, n, threshold, n >= threshold AS is_class FROM g, t""")
def fingerprint_threshold(t: Tables) -> DataFrame:
    rows = t.events.withColumn("bucket", F.col("user_id") % 7)
    return cluster.thresholded(rows, ["event_type", "bucket"], t.events.count())


#: Labels with what they ask for, decided by hand: one for every rule at least, those that exclusions turn away, and some that ask for nothing known.
_LABELS = {
    "First Name*": "first_name", "Last name": "last_name", "Full name": "full_name", "E-mail address": "email", "Mobile number": "phone", "LinkedIn profile": "linkedin", "GitHub": "github",
    "Personal site": "portfolio", "City": "location_city", "Province": "location_state", "Country": "location_country", "Street address": "location_address", "Postal code": "location_zip",
    "Preferred first name": "preferred_name", "Your pronouns": "pronouns", "Are you authorized to work in the country you reside?": "work_authorized", "Eligible for long-term work": "work_authorized_longterm",
    "Will you now or in the future require sponsorship?": "needs_sponsorship", "What type of visa do you hold": "visa_status", "Please explain your work authorization": "immigration_explanation",
    "Gender identity": "eeo_gender", "Racial background": "eeo_race", "Are you Hispanic or Latino?": "eeo_hispanic", "Protected veteran": "eeo_veteran",
    "Do you have a disability or long-term health condition": "eeo_disability", "University": "school", "Highest education reached": "degree", "Field of study": "major", "GPA": "gpa",
    "Expected graduation": "graduation_date", "Expected salary": "compensation", "When can you start?": "start_date", "How many years have you used SQL?": "years_experience",
    "How long an internship do you want?": "internship_duration", "Internship start": "internship_start", "What field do you want for the internship": "internship_field",
    "Have you ever been employed by us?": "previously_employed", "Who referred you?": "referral", "Cover letter": "cover_letter", "Transcript": "transcript_undergrad", "Graduate school transcript": "school",
    "Graduate transcript": "transcript_grad", "Unofficial transcript": "transcript_undergrad", "I agree to the background check": "consent_background_check", "Background investigation": "consent_background_check",
    "I have read the privacy policy": "consent_privacy_policy", "GDPR notice": "consent_gdpr_notice", "Consent to SMS": "consent_sms_communication", "Notify me of job openings": "marketing_communications_optin",
    "Would you take part in a voluntary diversity survey": "consent_demographic_survey", "Emergency contact phone": None, "Confirm e-mail": None, "Company website": None, "If other, please specify": None,
    "Leave this field blank": None, "Favourite colour": None, "": None, "Select...": None, "Bonus and salary": None, "Resume/CV": None, "How did you hear about us?": None, "Earliest internship you could start": "internship_start",
    "How did you learn about the referral": None,
}
_QUOTED = ", ".join("'" + x.replace("'", "''") + "'" for x in _LABELS)
_FIELDS = f"""
    SELECT p_partkey, CASE WHEN p_size % 11 = 1 THEN 'hidden' ELSE 'text' END AS itype, CASE p_partkey % 9 WHEN 0 THEN 'email-12' WHEN 1 THEN 'edit-url' WHEN 2 THEN 'gclid' ELSE 'question_' || p_size END AS id,
    CASE WHEN p_size % 13 = 0 THEN 'given-name' ELSE '' END AS ac, element_at(array({_QUOTED}), cast(p_partkey % {len(_LABELS)} + 1 AS int)) AS label,
    CASE WHEN p_size % 2 = 0 THEN 'Your e-mail' ELSE '' END AS placeholder, CASE WHEN p_size % 5 = 0 THEN 'LinkedIn profile' ELSE 'Git link 14' END AS section, 'where is your portfolio' AS nearby, p_size % 3 = 0 AS req FROM part"""
_BY_HAND = "CASE label " + " ".join("WHEN '" + x.replace("'", "''") + f"' THEN '{c}'" for x, c in _LABELS.items() if c) + " END"


@query("C1_field_interpreter", f"""
    WITH f AS ({_FIELDS.replace("element_at(array(", "([").replace("), cast(p_partkey", "])[p_partkey").replace(" + 1 AS int))", " + 1]")}),
    l AS (SELECT *, trim(label) = '' AS no_label, trim(placeholder) = '' AS no_place, regexp_replace(id, '[-_]{{1,2}}\\d+$', '') AS stem FROM f),
    s AS (SELECT *, CASE WHEN id = 'edit-url' OR label = 'Leave this field blank' THEN 'honeypot' WHEN itype = 'hidden' AND id = 'gclid' THEN 'hidden_tracking_field' WHEN itype = 'hidden' THEN 'hidden_non_interactive_field'
        WHEN (no_label OR label = 'Select...') AND no_place AND itype = 'text' AND req THEN 'react_select_required_shim' WHEN label LIKE 'If other, please specify%' THEN 'other_followup' END AS structural,
        CASE WHEN ac = 'given-name' THEN 'first_name' END AS t1, CASE WHEN stem = 'email' THEN 'email' END AS t2, CASE WHEN NOT no_label THEN {_BY_HAND} END AS t3,
        CASE WHEN no_label AND NOT no_place THEN 'email' END AS t4, CASE WHEN no_label AND no_place AND length(section) >= 15 THEN 'linkedin' END AS t5,
        CASE WHEN no_label AND no_place THEN 'portfolio' END AS t6 FROM l)
    SELECT p_partkey, CASE WHEN structural IS NULL THEN coalesce(t1, t2, t3, t4, t5, t6) END AS category,
        CASE WHEN structural IS NOT NULL THEN structural WHEN t1 IS NOT NULL THEN 'autocomplete' WHEN t2 IS NOT NULL THEN 'id' WHEN t3 IS NOT NULL THEN 'label' WHEN t4 IS NOT NULL THEN 'placeholder' WHEN t5 IS NOT NULL THEN 'section' WHEN t6 IS NOT NULL THEN 'nearby_text' END AS tier
    FROM s""")
def field_interpreter(t: Tables) -> DataFrame:
    """All parts, each with one of the labels, by all tiers and all rules of the built-in table."""
    t.part.createOrReplaceTempView("__part")
    fields = t.spark.sql(_FIELDS.replace("FROM part", "FROM __part"))
    return classify.interpret(fields.withColumn("tag", F.lit("input"))).select("p_partkey", "category", "tier")


#: Topics with what answers them, decided by hand; a capability is null where nothing answers one.
_TOPICS = {
    "preferred_first_name": ("preferred_name", "supported"), "personal_website": ("portfolio", "supported"), "state": ("location_state", "supported"), "mailing_address": ("location_address", "supported"),
    "citizenship_status": ("work_authorized_longterm", "supported"), "visa_type": ("visa_status", "supported"), "education_end_date": ("graduation_date", "supported"), "skill_experience_years": ("years_experience", "supported"),
    "availability_start_date": ("start_date", "supported"), "employee_referral": ("referral", "supported"), "cover_letter_upload": ("cover_letter", "supported"),
    "current_employee_of_company": ("previously_employed_here", "supported"), "previously_employed_here": ("previously_employed", "supported"), "consent_gdpr_notice": ("consent_gdpr_notice", "supported"),
    "marketing_communications_optin": ("marketing_communications_optin", "supported"), "willing_to_relocate": (None, "unsupported"), "essay": (None, "unsupported"), "military_rank": (None, "unsupported"),
    "work_history_title": (None, "unsupported"), "how_heard_about_role": (None, "unsupported"), "resume_upload": (None, "unsupported"), "travel_willingness": (None, "unsupported"),
    "ai_tool_usage_disclosure": (None, "unsupported"), "never_heard_of": (None, "unknown"),
}
_TOPIC_ROWS = ", ".join(f"({k}, '{x}', {repr(c) if c else 'NULL'}, '{status}')" for k, (x, (c, status)) in enumerate(_TOPICS.items()))


@query("C4_C5_capability_map", f"""
    WITH m(k, topic, capability, status) AS (VALUES {_TOPIC_ROWS})
    SELECT p_partkey, topic, capability, status FROM part JOIN m ON k = p_partkey % {len(_TOPICS)}""")
def capability_map(t: Tables) -> DataFrame:
    """Topics of each sort and one that nobody knows."""
    topic = F.element_at(F.array(*map(F.lit, _TOPICS)), (F.col("p_partkey") % len(_TOPICS) + 1).cast("int"))
    rows = t.part.select("p_partkey", topic.alias("topic"))
    return rows.select("p_partkey", "topic", classify.capability(F.col("topic")).alias("capability"), classify.topic_status(F.col("topic")).alias("status"))


_CONSENTS = [*classify.CONSENT_DEFAULTS, "first_name"]


@query("C6_consent_policy", f"""
    WITH m AS (SELECT p_partkey, ([{", ".join(f"'{x}'" for x in _CONSENTS)}])[p_partkey % {len(_CONSENTS)} + 1] AS topic FROM part)
    SELECT p_partkey, topic, CASE WHEN topic IN ('consent_background_check', 'consent_privacy_policy', 'consent_gdpr_notice') THEN 'Yes|I agree|I consent|Accept|I understand and agree'
           WHEN topic <> 'first_name' THEN 'No|I do not consent|Decline|I don''t wish to|Prefer not to' END AS wordings FROM m""")
def consent_policy(t: Tables) -> DataFrame:
    topic = F.element_at(F.array(*map(F.lit, _CONSENTS)), (F.col("p_partkey") % len(_CONSENTS) + 1).cast("int"))
    rows = t.part.select("p_partkey", topic.alias("topic"))
    return rows.select("p_partkey", "topic", F.array_join(classify.consent_answer(F.col("topic")), "|").alias("wordings"))


#: Kinds of visa with the wording that forms prefer, decided by hand.
_VISAS = {
    "F1": "F1", "F1_OPT": "OPT", "F1_STEM_OPT": "STEM OPT", "J1": "J1", "H1B": "H1B", "H4_EAD": "H4 EAD", "L1": "L1", "O1": "O1", "TN": "TN", "E3": "E3", "US_CITIZEN": "US Citizen", "GREEN_CARD": "Green Card",
    "CONDITIONAL_GC": "Conditional Green Card", "PENDING_GC_EAD": "EAD", "ASYLUM_EAD": "Asylum", "DACA": "DACA", "NON_IMMIGRANT": "Non-immigrant Visa", "OTHER": "Other", "PREFER_NOT": "Prefer not to say", "nonsense": "Other",
}


@query("X29_visa_answers", f"""
    WITH m(k, visa, wording) AS (VALUES {", ".join(f"({k}, '{x}', '{w}')" for k, (x, w) in enumerate(_VISAS.items()))})
    SELECT c_custkey, visa, 'Yes' AS now, CASE WHEN visa IN ('H1B', 'US_CITIZEN', 'CONDITIONAL_GC', 'GREEN_CARD') THEN 'Yes' ELSE 'No' END AS longterm, wording
    FROM customer JOIN m ON k = c_custkey % {len(_VISAS)}""")
def visa_answers(t: Tables) -> DataFrame:
    """Every kind of visa and one that isn't any."""
    visa = F.element_at(F.array(*map(F.lit, _VISAS)), (F.col("c_custkey") % len(_VISAS) + 1).cast("int"))
    rows = t.customer.select("c_custkey", visa.alias("visa")).withColumn("v", classify.visa_answers(F.col("visa")))
    return rows.select("c_custkey", "visa", "v.now", "v.longterm", F.get("v.wordings", F.lit(0)).alias("wording"))


@query("C7_discovery_cascade", """
    WITH c AS (SELECT c_custkey AS company_id, c_name, 'slug-' || c_custkey AS slug FROM customer WHERE c_custkey % 2 = 0),
    s AS (SELECT c_custkey AS id, c_name, c_custkey FROM customer)
    SELECT id, CASE WHEN c_custkey % 2 = 0 THEN 'already_known' WHEN c_custkey % 3 = 0 THEN 'already_known' WHEN c_custkey % 5 = 0 THEN 'queued_manual' WHEN c_custkey % 7 = 0 THEN 'queued_manual' ELSE 'added' END AS result,
           CASE WHEN c_custkey % 2 = 0 THEN c_custkey WHEN c_custkey % 3 = 0 THEN c_custkey - 1 END AS company_id,
           CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'unknown_ats' WHEN c_custkey % 7 = 0 THEN 'known_ats_unclear_slug' END AS bucket,
           CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE 'own-' || c_custkey END AS slug FROM s WHERE c_custkey > 1""")
def discovery_cascade(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    companies = t.customer.where("c_custkey % 2 = 0").select(key.alias("company_id"), F.upper("c_name").alias("company_name"), F.concat(F.lit("slug-"), key).alias("slug"))
    staged = t.customer.where("c_custkey > 1").select(
        key.alias("id"), F.col("c_name").alias("company_name"),
        F.array(F.when(key % 3 == 0, F.concat(F.lit("slug-"), key - 1)).otherwise(F.concat(F.lit("own-"), key))).alias("candidates"), F.lit("x.example").alias("domain"),
        F.when(key % 5 != 0, "https://x.example/jobs").alias("career_url"), F.when(key % 7 == 0, "workday").otherwise("lever").alias("ats"), F.lit(None).cast("string").alias("slug"),
    )
    return classify.discover(staged, companies)


@query("C8_classify_once", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'metal' ELSE 'other' END AS label FROM part")
def classify_once(t: Tables) -> DataFrame:
    own = lambda c: F.when(F.contains(F.lower(c), F.lit("steel")), "metal").otherwise("other")
    return classify.classify_once(t.part, "p_type", own).select("p_partkey", "label")


@query("C9_fix_routing", """
    SELECT event_id, CASE WHEN event_type NOT IN ('error', 'click') THEN 'no_generalized_fix' WHEN event_id % 3 = 0 THEN 'needs_human_decision' WHEN event_id % 3 = 1 THEN 'no_generalized_fix'
    WHEN event_id % 2 = 0 THEN 'needs_human_decision' ELSE 'proposed_fix' END AS route FROM events""")
def fix_routing(t: Tables) -> DataFrame:
    reason = F.when(F.col("event_type").isin("error", "click"), "CLASSIFICATION_NO_MATCH").otherwise("FILL_FAILED")
    category = F.when(F.col("event_id") % 3 != 0, "email")
    term = F.when(F.col("event_id") % 3 == 2, "work")
    return t.events.select("event_id", classify.route_fix(reason, category, term, F.col("event_id") % 2 == 1).alias("route"))


@query("C11_decision_precedence", """
    WITH d AS (SELECT user_id AS k, event_type AS action, event_id AS value, event_id AS rank, event_id % 4 = 0 AS orig FROM events),
    keep AS (SELECT * FROM d WHERE orig OR k NOT IN (SELECT k FROM d WHERE orig))
    SELECT k AS key, action, arg_max(value, rank) AS value FROM keep GROUP BY k, action""")
def decision_precedence(t: Tables) -> DataFrame:
    rows = t.events.selectExpr("user_id AS key", "event_type AS action", "event_id AS value", "event_id AS source_rank", "event_id % 4 = 0 AS in_original")
    return classify.decided(rows).select("key", "action", "value")


@query("C12_harness_outcome", """
    SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'skipped_blocked' WHEN event_type = 'view' THEN 'timeout' WHEN event_type = 'signup' THEN 'no_job_available' WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'failed'
    WHEN event_id % 2 = 0 THEN 'mechanically_verified' WHEN event_type = 'click' THEN 'needs_review_non_submit' ELSE 'failed' END AS outcome, (event_id % 3)::INT AS n_attempts FROM events""")
def harness_outcome(t: Tables) -> DataFrame:
    phase = F.when(F.col("event_type") == "view", "timeout").when(F.col("event_type") == "signup", "no_job").when(F.col("event_type") == "click", "awaiting_review").otherwise("filling")
    outcome = classify.harness_outcome(phase, F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 3 == 0, 1).otherwise(0), F.col("event_id") % 11 == 0)
    line = F.lit("t=1 category=email label=Your e-mail status=landed")
    log = F.concat(F.array(F.lit("started")), F.array_repeat(line, (F.col("event_id") % 3).cast("int")))
    return t.events.select("event_id", outcome.alias("outcome"), F.size(classify.attempts_in_log(log)).alias("n_attempts"))


@query("X_company_suffix_slugs", "SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def company_suffix_slugs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.slug_of_name(F.col("p_brand")).alias("slug"))
