"""Queries on small tables of which a prefix or a part would give other rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import cluster
from corvane.plans import registry


@pytest.fixture
def run(spark, tmp_path):
    """Rows of a query on tables given as {name: (rows, schema)}."""

    def call(query, **tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return sorted(tuple(r) for r in registry.QUERIES[query](spark, str(tmp_path)).collect())

    return call


LONG = "plain words " * 60


def test_keywords_come_from_and_go_into_whole_texts(run):
    rows = [(1, LONG + "with real-time tails"), (2, "short"), (3, None)]
    found = run("X18_keyword_inject", documents=(rows, "doc_id long, text string"))
    assert found[:2] == [(1, text.inject("Skills: SQL\n" + rows[0][1], ["real-time"])), (2, "Skills: SQL\nshort")]


def test_bullets_are_rewritten_in_whole_texts(run):
    rows = [(1, LONG + "\n* the end and more"), (2, "a and b")]
    found = run("X20_bullet_rewrites", documents=(rows, "doc_id long, text string"))
    assert found == [(i, text.rewrite(t, [("* the", "this"), ("and ", "or ")])) for i, t in rows]


def test_signs_are_sought_in_whole_pages(run):
    rows = [(2, "<p>" + LONG + '<a href="https://jobs.lever.co/Late/1">')]
    assert run("X14_ats_of_page", pages=(rows, "page_id long, html string")) == [(2, "lever", "late")]


def test_long_chains_of_fingerprints_have_one_root(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, "b", "", [" ".join(words[k : k + 9])]) for k in range(50)]  # each alike only to those one or two on
    groups = spark.createDataFrame(rows, "k int, block string, pattern string, labels array<string>")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    found = cluster.merged_fingerprints(groups, "k", ["block"], "pattern", "labels").select(F.min("root"), F.max("root"), F.count("root")).first()
    assert tuple(found) == (0, 0, 50)


def test_similar_items_of_any_id_are_found(run):
    docs = [(k, " ".join(f"w{(k * 7 + i) % 40}" for i in range(8)) + " tail" * (k % 2)) for k in range(30)]
    items = [(k, " ".join(f"w{(k * 5 + i) % 40}" for i in range(9))) for k in range(30)]
    sets = lambda rows: {k: set(t.split()) for k, t in rows}
    want = []
    for k, a in sets(docs).items():
        score, least = max((len(a & b) / len(a | b), -i) for i, b in sets(items).items())
        want += [(k, -least, score)] if score >= 0.3 else []
    assert want and run("J14_documents_best_match", documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string")) == want


def test_technical_terms_late_in_a_text_count(run):
    assert run("X17_technical_terms", documents=([(1, LONG + "real-time")], "doc_id long, text string")) == [(1, 1)]


def test_keywords_late_in_a_text_are_present(run):
    rows = [("a", 0, "kubernetes"), ("a", 1, LONG + "kubernetes")]
    assert run("X16_keyword_presence", conversations=(rows, "conv_id string, turn long, text string")) == [("a", 0, 1, 1)]


def test_events_of_any_id_are_compared(run):
    rows = [(k, '{"k": "7"}') for k in range(5)]
    assert [r[0] for r in run("X_snapshot_diff", events=(rows, "event_id long, props string"))] == [0, 1, 2, 3, 4]


def test_orders_of_any_customer_are_paired(run):
    rows = [(1, 2, "p", "F", "2024-03-01"), (2, 2, "p", "O", "2024-03-02"), (3, 5, "p", "O", "2024-04-02")]
    found = run("J15_paired_top5", orders=(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate string"))
    assert found == [("p", 3, 2)]


@pytest.mark.parametrize("query", ["X7_page_text", "X8_visible_text"])
def test_sql_reads_character_references_as_the_parser_does(query):
    import duckdb
    import pandas as pd

    found = ["&amp", "&am", "&quot", "&copyx", "&notit;", "&notin;", "&ampamp;", "&amplt;", "&#65;", "&#x41", "&#150;", "&#0;", "&#1;", "&#99999999999;", "&nbsp;", "&nothing;", "&", "&&amp;&"]
    pages = pd.DataFrame([(k, f"<title>cut {r}</title><p>{r}in {r}</p><script>raw {r}</script>") for k, r in enumerate(found)] + [(99, None)], columns=["page_id", "html"])
    with duckdb.connect() as held:
        held.register("pages", pages)
        told = dict(held.sql(registry.ORACLE_SQL[query]).fetchall())
    read = text.page_text if query == "X7_page_text" else text.visible_text
    assert told == dict(zip(pages.page_id, read.func(pages.html))) and told[0].startswith("cut &\n" if query == "X7_page_text" else "cut & &in")
