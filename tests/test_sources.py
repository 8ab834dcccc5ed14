"""The data source of boards, the table function of forms, rules by an index of literals, the anonymous cube."""

from __future__ import annotations

import json
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import rules
from corvane.operators import aggregates, classify, joins
from corvane.sources import boards, forms, readers
from corvane.streaming import streams


def put(root, board, offset, body, name="a.txt"):
    folder = root / "pages" / f"board={board}" / f"offset={offset}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(body if isinstance(body, str) else json.dumps(body))


def etag(root, name, **etags):
    (root / "etags").mkdir(exist_ok=True)
    (root / "etags" / name).write_text("\n".join(json.dumps({"board": b, "etag": e}) for b, e in etags.items()))


def page(total, *ids):
    return {"totalFound": total, "content": [{"id": i, "name": f"job {i}"} for i in ids]}


@pytest.fixture
def landed(spark, tmp_path):
    boards.register(spark)
    put(tmp_path, "x", 0, page(3, "1", "2"))
    put(tmp_path, "x", 2, page(3, "3"))
    put(tmp_path, "x", 4, page(3, "9"))  # left over from a longer list
    put(tmp_path, "y", 0, "<html>")
    put(tmp_path, "z", 0, page(1, "5"))
    (tmp_path / "pages" / "board=z" / "offset=0" / "_SUCCESS").write_text("")
    etag(tmp_path, "1.json", x="e1", y="e1", z="e1")
    return tmp_path


def test_boards_are_read_by_pages(spark, landed):
    df = spark.read.format("boards").option("total", "totalFound").option("blocked", "z").load(str(landed))
    assert sorted((r.company_slug, r.offset, r.etag) for r in df.collect()) == [("x", 0, "e1"), ("x", 2, "e1"), ("y", 0, "e1")]
    assert df.rdd.getNumPartitions() == 4  # every page of x and y
    assert sorted(r.job_id for r in readers.smartrecruiters_jobs(df).collect()) == ["1", "2", "3"]
    assert spark.read.format("boards").load(f"file://{landed}").count() == 5
    assert spark.read.format("boards").load(str(landed / "absent")).count() == 0


def test_many_pages_are_written_and_read_in_few_tasks(spark, tmp_path):
    boards.register(spark)
    rows = [(f"b{k % 7}", k // 7 * 2, json.dumps(page(2000, str(k)))) for k in range(700)]
    rows += [rows[0], ("b0", 0, "é <html>")]  # the same page twice, and another body of it
    spark.createDataFrame(rows, "company_slug string, offset int, payload string").write.format("boards").mode("append").save(str(tmp_path))
    read = spark.read.format("boards").option("total", "totalFound").load(str(tmp_path))
    assert 100 < read.rdd.getNumPartitions() <= 256 and sorted((r.company_slug, r.offset, r.payload) for r in read.collect()) == sorted(rows)
    few = spark.read.format("boards").option("partitions", 3).load(str(tmp_path))
    assert few.rdd.getNumPartitions() == 3 and few.count() == 702
    assert not [f for _, _, names in os.walk(tmp_path) for f in names if f.startswith(".")]


def test_many_changed_pages_are_few_partitions_of_a_stream(spark, tmp_path):
    for k in range(600):
        put(tmp_path, f"b{k % 3}", k // 3, page(1000, str(k)))
    etag(tmp_path, "1.json", b0="e", b1="e", b2="e")
    reader = boards.BoardStreamReader({"path": str(tmp_path)})
    found = reader.partitions({"b1": "e"}, reader.latestOffset())
    assert len(found) <= 256 and sum(1 for part in found for _ in reader.read(part)) == 400
    boards.register(spark)
    assert streams.run_to_table(spark.readStream.format("boards").load(str(tmp_path)), str(tmp_path / "run"), "t").count() == 600


def test_an_unchanged_board_is_not_read_again(spark, landed, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run"))
    cycle = lambda: sorted((r.company_slug, r.offset, r.etag) for r in streams.run_to_table(spark.readStream.format("boards").option("total", "totalFound").load(str(landed)), out, "t").collect())
    first = [("x", 0, "e1"), ("x", 2, "e1"), ("y", 0, "e1"), ("z", 0, "e1")]
    assert cycle() == first
    for board in ("y", "x"):  # what isn't read can't fail
        os.chmod(landed / "pages" / f"board={board}", 0)
    put(landed, "z", 0, page(1, "6"))
    put(landed, "new", 0, page(1, "7"))
    etag(landed, "2.json", z="e2", new="n1")
    try:
        assert cycle() == sorted([*first, ("z", 0, "e2"), ("new", 0, "n1")])
        assert cycle() == sorted([*first, ("z", 0, "e2"), ("new", 0, "n1")])
    finally:
        for board in ("y", "x"):
            os.chmod(landed / "pages" / f"board={board}", 0o755)


PAGES = [
    (1, '<label for="e">E-mail</label><input id="e" name="email" type="email" required autocomplete="email"><label>City<select name="city"></select></label>'),
    (2, None), (3, ""), (4, "<textarea name=t placeholder='say'>x</textarea><p>no label"), (5, "<input" * 3),
]


def test_form_fields_from_sql(spark):
    forms.register(spark)
    pages = spark.createDataFrame(PAGES, "page_id long, html string")
    found = spark.sql("SELECT p.page_id AS page, f.* FROM {pages} AS p, LATERAL form_fields(p.html) AS f", pages=pages)
    want = readers.page_fields(pages, "page_id", "html")
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert found.where("page = 1").count() == 2 and found.where("page in (2, 3)").count() == 0
    with pytest.raises(Exception, match="form_fields takes"):
        spark.sql("SELECT * FROM form_fields(3)").collect()


@pytest.mark.parametrize("pattern, found", [
    (r"first.?name", ["first"]), (r"\bgpa\b", ["gpa"]), (r"e-?mail", ["mail"]), (r"worked (here|with us|for us)", ["worked "]), (r"x.*(abc|de)", None), (r"(sms|text message).{0,60}(allow|contact)", ["allow", "contact"]),
    (r"phone|mobile", ["phone", "mobile"]), (r"\d+", None), (r"^name$", ["name"]), (r"(abc)?xyzw", ["xyzw"]), (r"(abcde)+x", ["abcde"]), (r"ab|cdef", None),
])
def test_literals_of_patterns(pattern, found):
    assert rules.literals(pattern) == found


def brute(text, table):
    for name, patterns, exclusions in table:
        if not any(re.search(x, text, re.I) for x in exclusions) and any(re.search(p, text, re.I) for p in patterns):
            return name
    return None


def test_thousands_of_rules_by_the_index(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    shapes = [lambda a, b: f"{a}.?{b}", lambda a, b: rf"\b{a}\b", lambda a, b: f"{a}.*{b}", lambda a, b: f"({a}|{b})", lambda a, b: f"^{a} {b}$", lambda a, b: f"{a}[xyz]?{b}"]
    table = [(f"rule{k}", [rng.choice(shapes)(rng.choice(words), rng.choice(words)) for _ in range(rng.randint(1, 2))], [rng.choice(words)] if rng.random() < 0.4 else []) for k in range(5000)]
    table[17] = ("digits", [r"\d{3}"], ["zz"])
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(150)] + ["x 123", "x 123 zz", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)], "id int, t string")
    found = rules.with_first_indexed(df, F.col("t"), table, "rule").collect()
    assert len(found) == len(texts) * 2
    want = {t: brute(t, table) for t in texts if t is not None} | {None: None}
    assert all(r.rule == want[r.t] for r in found)
    assert sum(r.rule is not None for r in found) > 150


def test_interpreter_by_the_index_is_the_same(spark, monkeypatch):
    from corvane.plans import matching

    schema = "tag string, itype string, id string, ac string, label string, placeholder string, section string, nearby string, req boolean"
    labels = [*matching._LABELS, "Protected veteran status", "please list, if yes please list"]
    given = [("input", "text", "q", "", label, "", "", "", False) for label in labels] + [("input", "text", "q", "", "", label, "", "", False) for label in labels] + [("input", "text", "q", "", "", "", label + " " * 9 + ".......", label, False) for label in labels]
    fields = spark.createDataFrame(given, schema)
    own = ["label", "placeholder", "section", "category", "confidence", "tier", "action"]
    plain = sorted((tuple(r) for r in classify.interpret(fields).select(own).collect()), key=str)
    monkeypatch.setattr(classify, "INDEX_FROM", 1)
    assert sorted((tuple(r) for r in classify.interpret(fields).select(own).collect()), key=str) == plain


def test_every_rule_of_labels_can_be_met(spark):
    from corvane.plans import matching

    assert {name for name, _, _ in classify.LABEL_RULES + classify.CONSENT_RULES} <= set(matching._LABELS.values())
    assert not set(classify.CAPABILITIES) & set(classify.UNSUPPORTED) and len(classify.CAPABILITIES) + len(classify.UNSUPPORTED) == 121
    assert set(classify.VISA_WORDINGS) == set(classify.VISA_WORK)


@pytest.mark.parametrize("seed", range(3))
def test_withheld_cells_cannot_be_solved_for(spark, seed):
    """The sums that are published leave every withheld count open."""
    rng = random.Random(seed)
    rows = [(rng.choice("abcdefg"), rng.choice("uvwxyz"), rng.randint(0, 40)) for _ in range(160)] + [("h", "u", 1), ("a", "t", 1), ("q", "r", 2), (None, "v", 3)]
    rows = [r for r in rows if r[:2] not in (("b", "w"), ("c", "x"))]
    df = spark.createDataFrame(rows, "p string, q string, user int")
    kept = aggregates.anonymous_cube(df, "p", "q", "user", 4).collect()
    assert all(r.users >= 4 for r in kept) and kept
    key = lambda r: ("*" if r.is_total_first else (r.first_value,), "*" if r.is_total_second else (r.second_value,))
    published = {key(r): r.n for r in kept}
    assert len(published) == len(kept)
    cells = {((p,), (q,)) for p, q, _ in rows}
    firsts, seconds = {c[0] for c in cells}, {c[1] for c in cells}
    every = cells | {(a, "*") for a in firsts} | {("*", b) for b in seconds} | {("*", "*")}
    hidden = sorted(every - set(published), key=str)
    at = {c: k for k, c in enumerate(hidden)}
    lines = [([(a, b) for b in seconds if (a, b) in cells], (a, "*")) for a in firsts] + [([(a, b) for a in firsts if (a, b) in cells], ("*", b)) for b in seconds]
    lines += [([(a, "*") for a in firsts], ("*", "*")), ([("*", b) for b in seconds], ("*", "*"))]
    m = np.zeros((len(lines), len(hidden)))
    for k, (parts, total) in enumerate(lines):
        for c in parts:
            if c in at:
                m[k, at[c]] += 1
        if total in at:
            m[k, at[total]] -= 1
    # A withheld count is settled if its unit vector lies in the row space of the sums.
    rank = np.linalg.matrix_rank(m)
    assert hidden and all(np.linalg.matrix_rank(np.vstack([m, np.eye(len(hidden))[k]])) > rank for k in range(len(hidden)))


def test_best_similar_is_that_of_all_pairs(spark):
    rng = random.Random(9)
    terms = [f"t{k}" for k in range(14)]
    left = [(k, rng.sample(terms, rng.randint(0, 8)) * rng.randint(1, 2)) for k in range(120)]
    right = [(1000 + k, rng.sample(terms, rng.randint(0, 8))) for k in range(100)]
    for least in (0.3, 0.6, 0.9):
        found = joins.best_similar(spark.createDataFrame(left, "l int, t array<string>"), spark.createDataFrame(right, "r int, u array<string>"), "l", "r", "t", "u", least)
        want = []
        for i, t in left:
            scored = [(-len(set(t) & set(u)) / len(set(t) | set(u)), j) for j, u in right if t and u]
            if scored and -min(scored)[0] >= least:
                want.append((i, min(scored)[1], round(-min(scored)[0], 9)))
        assert sorted((r.l, r.r, round(r.score, 9)) for r in found.collect()) == sorted(want)
