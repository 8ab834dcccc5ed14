"""Hand-written edge rows: nulls, empty strings, repeated keys, ties, thresholds."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import classify, filters, joins, lifecycle, matching, merge, windows
from corvane.plans import registry
from corvane.sources import readers, sinks
from corvane.streaming import streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_insert_if_absent_takes_first_of_repeated_keys(spark):
    state = spark.createDataFrame([(1, "held")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k int, v string")
    assert rows(merge.insert_if_absent(state, new, ["k"], [F.col("v")])) == [(1, "held"), (2, "a")]


def test_insert_into_empty_state(spark):
    state = spark.createDataFrame([], "k int, v string")
    assert rows(merge.insert_if_absent(state, state, ["k"], [F.col("v")])) == []


def test_fill_empty_keeps_null_and_full(spark):
    state = spark.createDataFrame([(1, ""), (2, "x"), (3, None), (4, "")], "k int, v string")
    new = spark.createDataFrame([(1, "n"), (2, "n"), (3, "n"), (4, "")], "k int, v string")
    assert sorted(merge.fill_empty(state, new, ["k"], ["v"]).collect()) == [(1, "n"), (2, "x"), (3, None), (4, "")]


def test_json_merge_right_side_wins_and_null_counts_as_empty(spark):
    assert one(spark, merge.json_merge(F.lit('{"a": 1, "b": {"c": 2}}'), F.lit('{"b": "x"}'))) == '{"a":1,"b":"x"}'
    assert one(spark, merge.json_merge(F.lit(None).cast("string"), F.lit('{"b": null}'))) == '{"b":null}'


def test_append_valid_refuses_other_values(spark):
    log = spark.createDataFrame([], "v string")
    with pytest.raises(PySparkException):
        merge.append_valid(log, spark.createDataFrame([("odd",)], "v string"), "v", ["ok"]).collect()


def test_delete_keeps_rows_of_unknown_condition(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, c boolean")
    assert [r.k for r in merge.without(df, F.col("c")).orderBy("k").collect()] == [2, 3]


def test_null_reason_is_never_retried(spark):
    df = spark.createDataFrame([(1, None), (2, "posting_gone"), (3, "tailor_error: x"), (4, "other")], "k int, reason string")
    assert [r.k for r in df.where(filters.retriable("reason")).collect()] == [4]


def test_lease_at_now_is_not_over_and_retries_end(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    items = spark.sql(
        "SELECT 1 AS id, 'submitting' AS status, 0 AS retry_count, cast(NULL AS string) AS failure_reason, TIMESTAMP '2024-01-01 00:00:00' AS updated_at, TIMESTAMP '2024-01-01 00:00:00' AS lease_expires_at "
        "UNION ALL SELECT 2, 'submitting', 2, 'x', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2023-12-31 23:59:59'"
    )
    found = {r.id: (r.status, r.failure_reason, r.retry_count) for r in lifecycle.sweep(items, now).collect()}
    assert found == {1: ("submitting", None, 0), 2: ("abandoned", "x", 3)}
    released = {r.id: r.status for r in lifecycle.release(items, F.lit("r")).collect()}
    assert released == {1: "ready", 2: "abandoned"}


def test_streak_resets_and_neutral_rows_do_nothing(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("FFNFRF")], "i int, c string").withColumn("k", F.lit(1))
    found = windows.streaks(df, ["k"], [F.col("i")], F.col("c") == "F", F.col("c") == "R").orderBy("i")
    assert [r.streak for r in found.collect()] == [1, 2, 2, 3, 0, 1]


def test_versions_reuse_and_active_is_last_made(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "i int, t string").withColumn("k", F.lit(1))
    found = windows.content_versions(df, ["k"], [F.col("i")], "t").orderBy("i").collect()
    assert [(r.version, r.active) for r in found] == [(1, False), (2, True), (1, False)]


def test_years_come_as_a_pair(spark):
    years = lambda *t: one(spark, text.experience_years(*[F.lit(x).cast("string") for x in t]))
    assert tuple(years("5-7 years of experience")) == (5, 7)
    assert tuple(years(None, "3+ years experience", "9 years experience")) == (3, None)
    assert years("no number") is None


def test_title_gate_corner(spark):
    gate = lambda t: one(spark, text.is_role(F.lit(t)))
    assert gate("Software Intern") and gate("Sr. Engineer Intern") and not gate("Sr Engineer Intern") and not gate("Internal Audit")


def test_categories_title_first(spark):
    found = one(spark, text.categories(F.lit("Data Engineer"), F.lit("marketing")))
    assert found == ["data_engineering"]
    assert one(spark, text.categories(F.lit("Associate"), F.lit("marketing and sales associate"))) == ["marketing", "sales"]
    assert one(spark, text.categories(F.lit("Associate"), F.lit(None).cast("string"))) == []


def test_country_and_domain(spark):
    from corvane.functions import places

    assert one(spark, places.country_of_name(F.lit(" Germany "))) == "DE" and one(spark, places.country_of_name(F.lit("Austalia"))) is None
    assert one(spark, text.bare_domain(F.lit("WWW.x.example:80/a"))) == "www.x.example:80"
    assert one(spark, text.bare_domain(F.lit("https://www.X.example/a"))) == "x.example" and one(spark, text.bare_domain(F.lit(" "))) is None


def test_display_name_and_html(spark):
    assert one(spark, text.display_name(F.lit("3d-systems"))) == "3D Systems"
    assert one(spark, text.visible_text(F.lit("<p>a</p><script>x</script> b"))) == "a b"
    assert one(spark, text.page_text(F.lit("<p>a</p><p>b</p>"))) == "a\nb"
    assert one(spark, text.link_named("Original")(F.lit('<a href="/x">Original Job</a>'))) == "/x"


def test_keyword_injection():
    assert text.inject("Skills: SQL\nx", ["aws"]) == "Skills: SQL, aws\nx"
    assert text.inject("Skills\nSQL,\nEducation\ny", ["aws"]) == "Skills\nSQL, aws\nEducation\ny"
    assert text.inject("nothing", ["aws"]) == "nothing\n\nSkills\naws\n" and text.inject("x", []) == "x"
    assert text.rewrite("- did it\n", [("* did it", "made it")]) == "- made it\n"


def test_relevance_rounds_half_to_even(spark):
    assert one(spark, matching.relevance(F.lit(0.625))) == 62 and one(spark, matching.relevance(F.lit(-1.0))) == 0


def test_jaccard_of_nothing_is_zero(spark):
    assert one(spark, matching.jaccard(matching.tokens(F.lit("")), matching.tokens(F.lit("")))) == 0.0


def test_similarity_join_takes_the_first_of_equals_and_the_threshold(spark):
    a = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"])], "l int, t array<string>")
    b = spark.createDataFrame([(8, ["a", "b", "c", "d", "e"]), (7, ["a", "b", "c", "d", "e"]), (9, ["q"])], "r int, u array<string>")
    assert rows(joins.best_similar(a, b, "l", "r", "t", "u", 0.6)) == [(1, 7, 0.6)]


def test_similarity_join_stores_only_what_can_match(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
    wide = spark.range(200).selectExpr("id AS l", "transform(sequence(1, 1500), x -> concat('w', x * 7919 + id)) AS t")
    near = spark.range(200).selectExpr("id + 1000 AS l", "concat(array('a', 'b', 'c', 'd'), array(concat('own', id))) AS t")
    right = spark.createDataFrame([(8, ["a", "b", "c", "d"]), (7, ["q", "w7919"])], "r int, u array<string>")
    before = held()
    found = joins.best_similar(wide.unionByName(near), right, "l", "r", "t", "u", 0.6)
    assert rows(found) == [(1000 + k, 8, 0.8) for k in range(200)]
    assert held() - before < 200_000  # the left side has 300,000 terms


def test_interpreter_tiers(spark):
    schema = "tag string, itype string, id string, ac string, label string, placeholder string, section string, nearby string, req boolean"
    given = [
        ("input", "text", "edit-url", "", "x", "", "", "", False), ("input", "hidden", "a", "", "website " * 50, "", "", "", False), ("input", "text", "", "", "", "", "", "", True),
        ("input", "text", "q", "given-name", "Email", "", "", "", False), ("input", "text", "email-12", "", "Phone", "", "", "", False), ("input", "text", "q", "", "phonetic name", "", "", "", False),
        ("input", "text", "q", "", "", "Your e-mail", "", "", False), ("input", "text", "q", "", "", "", "your linkedin!", "", False), ("input", "text", "q", "", "", "", "your linkedin!!", "", False),
        ("input", "text", "q", "", "nothing known", "e-mail", "linkedin linkedin", "", False), ("input", "text", "", "", "If other, please specify", "", "", "", False),
    ]
    found = [(r.category, r.tier) for r in classify.interpret(spark.createDataFrame(given, schema).coalesce(1)).collect()]
    assert found == [
        (None, "honeypot"), (None, "hidden_non_interactive_field"), (None, "react_select_required_shim"), ("first_name", "autocomplete"), ("email", "id"), (None, None), ("email", "placeholder"), (None, None),
        ("linkedin", "section"), (None, None), (None, "other_followup"),
    ]


def test_labels_that_once_went_wrong(spark):
    """Labels whose first wording of the rules gave something else."""
    known = [
        ("Are you authorized to work in the country you reside or where you are living?*", "work_authorized"),
        ("Will you now or in the future require sponsorship for employment visa status in the country for which this role is based?*", "needs_sponsorship"),
        ("Are you a current or former civilian or military employee of the United States Government? (If yes, when/where were you last employed and what was you", "previously_employed"),
        ("Will you now or in the future require sponsorship for employment visa status (e.g., H-1B visa status)?*", "needs_sponsorship"),
        ("Do you consider yourself to have a disability, impairment or long-term health condition", "eeo_disability"),
        ("Are you currently, or have you ever in the past, been employed by Studs?*", "previously_employed"),
        ("What is your preferred name/nickname? Please feel free to include phonetic pronunciation", "preferred_name"),
        ("Are you willing to undergo a background check, in accordance with local law/regulations?*", "consent_background_check"),
        ("Applicant Privacy Acknowledgement *", "consent_privacy_policy"),
        ("By selecting “Consent” below, you confirm that you have been informed of your rights under GDPR and that you consent to the processing of your data.", "consent_gdpr_notice"),
        ("Do you allow us to provide you TEXT/SMS updates of your interview process? We may engage with a service provider to do so.*", "consent_sms_communication"),
        ("Email me about other job openings within the entities and recruitment-related newsletters*", "marketing_communications_optin"),
        ("We invite you to voluntarily provide demographic information in a confidential survey at the end of this application. Would you like to participate?", "consent_demographic_survey"),
    ]
    schema = "tag string, itype string, id string, ac string, label string, placeholder string, section string, nearby string, req boolean"
    fields = spark.createDataFrame([("input", "text", "q", "", label, "", "", "", False) for label, _ in known], schema).coalesce(1)
    assert [r.category for r in classify.interpret(fields).collect()] == [c for _, c in known]


def test_repeated_keys_of_a_change_are_settled(spark):
    state = spark.createDataFrame([(1, ""), (2, "x")], "k int, v string")
    change = spark.createDataFrame([(1, "b"), (1, ""), (1, "a"), (2, "y"), (2, "z")], "k int, v string")
    assert rows(merge.fill_empty(state, change, ["k"], ["v"])) == [(1, "a"), (2, "x")]
    json = spark.createDataFrame([(1, "{}"), (2, None)], "k int, v string")
    more = spark.createDataFrame([(1, '{"b":1}'), (1, '{"a":1}'), (2, "{}"), (2, None)], "k int, v string")
    assert sorted(map(tuple, merge.fill_empty_json(json, more, ["k"], "v").collect()), key=str) == [(1, '{"a":1}'), (2, None)]
    held = spark.createDataFrame([("a", "1")], "name string, id string")
    new = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "name string")
    got = merge.insert_or_get(held, new, ["name"], "id", F.uuid()).collect()
    ids = {}
    for r in got:
        ids.setdefault(r.name, set()).add(r.id)
    assert len(got) == 4 and ids["a"] == {"1"} and len(ids["b"]) == 1 and None not in {i for s in ids.values() for i in s}


def test_sources_of_one_batch_are_all_united(spark):
    state = spark.createDataFrame([(1, ["x"], 0)], "k int, s array<string>, at int")
    batch = spark.createDataFrame([(1, ["y"], 1), (1, ["z", "x"], 2), (2, ["p"], 1), (2, ["q"], 2)], "k int, s array<string>, at int")
    found = merge.upsert_merging(state, batch, ["k"], [F.desc("at")], "s")
    assert rows(found) == [(1, ["x", "z", "y"], 2), (2, ["q", "p"], 2)]


def test_high_water_survives_a_replay(spark, tmp_path):
    import os

    src, run = tmp_path / "in", str(tmp_path / "run")
    schema = "k long, at timestamp"
    spark.sql("SELECT 1L AS k, TIMESTAMP '2024-01-01' AS at UNION ALL SELECT 2L, TIMESTAMP '2024-01-02'").coalesce(1).write.parquet(str(src))
    cursor = streams.Versions(spark, f"{run}/cursor", "batch bigint, at timestamp")
    once = lambda: rows(streams.above_high_water(spark.readStream.schema(schema).parquet(str(src)), run, "at", cursor).select("k"))
    assert once() == [(1,), (2,)]
    for name in os.listdir(f"{run}/high-water.offsets/commits"):
        if not name.startswith("."):
            os.remove(f"{run}/high-water.offsets/commits/{name}")
        elif os.path.exists(f"{run}/high-water.offsets/commits/{name}"):
            os.remove(f"{run}/high-water.offsets/commits/{name}")
    assert once() == [(1,), (2,)]
    spark.sql("SELECT 3L AS k, TIMESTAMP '2024-01-03' AS at UNION ALL SELECT 4L, TIMESTAMP '2023-01-03'").coalesce(1).write.mode("append").parquet(str(src))
    assert once() == [(1,), (2,), (3,)]


def test_page_marks_stand_on_one_line(spark):
    issues = lambda t: one(spark, text.format_issues(F.lit(t)))
    assert "page number" not in issues("page\n1 of 2") and "page number" in issues("x\nPage 1 of 2") and "page number" in issues("x\n - 3 -\ny")


def test_other_headings_end_the_skills(spark):
    assert text.inject("Tech Stack\nSQL\nWork History\nx", ["aws"]) == "Tech Stack\nSQL, aws\nWork History\nx"


def test_hard_filters_pass_what_is_not_stated(spark):
    jobs = spark.sql("SELECT 1 AS job, array('a', 'b') AS categories, 'Unknown' AS work_model, cast(NULL AS string) AS h1b_sponsored, cast(NULL AS int) AS years_min, cast(NULL AS string) AS location, 'co' AS company_slug")
    users = spark.sql("SELECT 1 AS user, array('b', 'a') AS wanted_categories, cast(array() AS array<string>) AS work_models, true AS needs_sponsorship, cast(NULL AS int) AS years, cast(NULL AS array<string>) AS locations, cast(NULL AS array<string>) AS blacklisted")
    assert matching.match(jobs, users).count() == 1
    assert matching.match(jobs, users.withColumn("blacklisted", F.array(F.lit("co")))).count() == 0


def _jobs_and_users(spark):
    pick = lambda column, values: f"element_at(array({values}), cast(pmod(hash({column}, {len(values)}), {values.count('|') + 1}) + 1 AS int))".replace("|", ",")
    jobs = spark.range(120).selectExpr(
        "nullif(id % 100, 7) AS job", pick("id", "array('a', 'b') | array('b') | array('a', 'a', 'c') | cast(NULL AS array<string>)") + " AS categories", pick("id", "'Unknown' | 'Remote' | 'On-Site' | NULL") + " AS work_model",
        pick("id", "'No' | 'Yes' | NULL") + " AS h1b_sponsored", pick("id", "NULL | 1 | 3") + " AS years_min", pick("id", "NULL | 'City 1, land' | ''") + " AS location", pick("id", "'co1' | 'co2' | NULL") + " AS company_slug",
    )
    users = spark.range(150).selectExpr(
        "nullif(id % 140, 9) AS user", pick("id", "array('b', 'a') | array('c') | array('a')") + " AS wanted_categories", pick("id", "array('Remote') | array('Remote', 'On-Site') | NULL") + " AS work_models",
        pick("id", "true | false | NULL") + " AS needs_sponsorship", pick("id", "2 | NULL | 5") + " AS years", pick("id", "array('city 1') | array() | NULL") + " AS locations", pick("id", "array('co1') | NULL | array()") + " AS blacklisted",
    )
    return jobs, users


def test_jobs_and_users_of_the_same_facts_match_as_one(spark):
    jobs, users = _jobs_and_users(spark)
    want = rows(matching.match(jobs, users).selectExpr("nvl(j.job, -1)", "nvl(u.user, -1)"))
    assert len(want) > 500 and -1 in {w[0] for w in want} & {w[1] for w in want}
    for most in (1, 3, 1024):
        pairs = matching.match_alike(matching.alike(jobs, matching.JOB_FACTS, "job", most), matching.alike(users, matching.USER_FACTS, "user", most), slices=5)
        expanded = pairs.select(F.explode("j.keys").alias("job"), "u.keys").select("job", F.explode("keys").alias("user"))
        assert rows(expanded.selectExpr("nvl(job, -1)", "nvl(user, -1)")) == want
    many = spark.range(5000).select(F.lit(1).alias("fact"), F.col("id").alias("key"))
    held = matching.alike(many, ["fact"], "key", 1000).select(F.size("keys").alias("n")).collect()
    assert sum(r.n for r in held) == 5000 and 2 <= len(held) <= 5


def test_matches_are_made_in_many_tasks(spark, tmp_path):
    spark.range(100).selectExpr("id AS s_suppkey", "cast(id % 25 AS int) AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(2000).selectExpr("id AS c_custkey", "cast(id % 25 AS int) AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    pairs = registry.QUERIES["J8_hard_filter_match"](spark, str(tmp_path))
    per_task = [n for n in pairs.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect() if n]
    assert len(per_task) >= 16 and max(per_task) < sum(per_task) / 4


def test_routes_are_counted_without_pairs(spark, tmp_path):
    """Two thousand million pairs, of which those of one period of all facts are known."""
    period, times = 1260, (30, 40)  # all facts of jobs and users repeat after so many keys
    for k, (jobs, users) in enumerate(((1, 1), times)):
        spark.range(period * jobs).selectExpr("id AS s_suppkey", "cast(id % 5 AS int) AS s_nationkey").write.parquet(str(tmp_path / f"{k}" / "supplier.parquet"))
        spark.range(period * users).selectExpr("id AS c_custkey", "cast(id % 5 AS int) AS c_nationkey").write.parquet(str(tmp_path / f"{k}" / "customer.parquet"))
    few, many = (dict(map(tuple, registry.QUERIES["V4_excluded_split"](spark, str(tmp_path / f"{k}")).collect())) for k in (0, 1))
    pairs = registry.QUERIES["J8_hard_filter_match"](spark, str(tmp_path / "0")).groupBy("route").count().collect()
    assert few == {r.route: r["count"] for r in pairs} and many == {route: n * times[0] * times[1] for route, n in few.items()}


def test_broken_payloads_give_no_jobs(spark):
    df = spark.createDataFrame([("a", "<html>"), ("b", '{"jobs": [{"id": 1}, {"id": 2, "title": "T", "location": null}]}'), ("c", None)], "company_slug string, payload string")
    assert [(r.job_id, r.location) for r in readers.greenhouse_jobs(df).collect()] == [("2", "Unknown")]


def test_missing_file_is_empty(spark, tmp_path):
    assert readers.json_or_empty(spark, str(tmp_path / "no"), "a int").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    sinks.write_markdown(df, str(tmp_path / "md"))
    assert [r.value for r in spark.read.text(str(tmp_path / "md")).collect()] == ["| a | b |", "|---|---|", "| 1 |  |"]
    assert sinks.replace_unless_empty(df, str(tmp_path / "p")) and not sinks.replace_unless_empty(df.limit(0), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_stream_state_outlives_a_batch(spark, tmp_path):
    """Two files, one a trigger: counters go on where they stopped."""
    src = tmp_path / "in"
    for k, kinds in enumerate((["error", "error"], ["error", "ok"])):
        spark.createDataFrame([("u", 10 * k + i, e) for i, e in enumerate(kinds)], "u string, i int, e string").coalesce(1).write.mode("append").parquet(str(src))
    stream = streams.file_stream(spark, str(src), files_per_trigger=1)
    out = streams.run_to_table(streams.failure_counters(stream, "u", ["i"], "e", ["error"], ["ok"], 3), str(tmp_path / "out"), "c")
    found = rows(out)
    assert len(found) == 2 and sum(f[1] for f in found) in (2, 3) and (("u", 0, False) in found or ("u", 3, False) in found or ("u", 2, True) in found)


def test_repeated_batch_adds_nothing(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1,), (2,)], "k long").write.parquet(str(src))
    state = streams.Versions(spark, str(tmp_path / "state"), "k long")
    for turn in range(2):
        got = streams.insert_once(streams.file_stream(spark, str(src)), str(tmp_path / f"run{turn}"), ["k"], state)
    assert rows(got) == [(1,), (2,)]


def test_windowed_counts_are_the_batch_counts_of_closed_windows(spark, tmp_path):
    src = tmp_path / "in"
    rows_ = [("a", "2024-01-01 01:00:00"), ("a", "2024-01-01 23:00:00"), ("b", "2024-01-02 05:00:00"), ("a", "2024-01-04 00:00:00")]
    spark.createDataFrame(rows_, "k string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(src))
    found = streams.run_to_table(streams.windowed_counts(streams.file_stream(spark, str(src)), "at", "1 day", "k", "1 hour"), str(tmp_path / "out"), "c")
    assert sorted((str(r.window.start), r.k, r.n) for r in found.collect()) == [("2024-01-01 00:00:00", "a", 2), ("2024-01-02 00:00:00", "b", 1)]


def test_leases_expire_or_are_released(spark, tmp_path):
    src = tmp_path / "in"
    rows_ = [("a", "lease", "2024-01-01 00:00:00"), ("b", "lease", "2024-01-01 00:00:00"), ("b", "release", "2024-01-01 00:05:00"), ("c", "lease", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows_, "k string, e string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(src))
    found = streams.run_to_table(streams.expiring_leases(streams.file_stream(spark, str(src)), "k", "at", "e", 10), str(tmp_path / "out"), "c")
    assert {(r.k, r.status) for r in found.collect()} == {("a", "leased"), ("a", "lease_expired"), ("b", "released"), ("c", "leased")}
