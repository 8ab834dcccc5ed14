"""The registered opN queries, thin over the operators, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.collocations import collocations
from corvane.llm.common import LOWER, UPPER
from corvane.llm.decontaminate import contaminated, decontaminate
from corvane.llm.exact_dedup import exact_dedup
from corvane.llm import language_id, quality, toxicity
from corvane.llm.labelled import held_out
from corvane.llm.line_dedup import line_dedup
from corvane.llm.lm_scoring import lm_scores
from corvane.llm.mixing import mix
from corvane.llm.simhash import simhash_groups
from corvane.llm.spelling import spelling_groups
from corvane.llm.token_shards import token_shards
from corvane.llm.url_filter import filter_urls

#: The rules of the URL query, as (verdict, host, path).
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark, table(spark, sf_dir, "documents"))
    return found.select(
        F.col("row_id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(spark, table(spark, sf_dir, "pages"), URL_RULES)
    return found.withColumnRenamed("row_id", "page_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark, table(spark, sf_dir, "documents")).withColumnRenamed("row_id", "doc_id")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(spark, table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.train(spark, docs, table(spark, sf_dir, "labels"))
    return judged(quality.score_quality(docs, rules), 0.3)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(spark, table(spark, sf_dir, "documents"))
    return found.select(F.col("row_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(spark, table(spark, sf_dir, "documents"))
    return found.select(F.col("row_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    return judged(toxicity.score_texts(spark, docs, scorer), 0.5)


def judged(scores: DataFrame, least: float) -> DataFrame:
    return scores.select(
        F.col("row_id").alias("doc_id"), held_out("row_id").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(spark, table(spark, sf_dir, "documents"))
    return found.select(
        F.col("row_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(spark, table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.languages(spark, docs, language_id.train(spark, docs))
    return found.select(F.col("row_id").alias("doc_id"), language_id.held_out("row_id").alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_decontaminate": op3_decontaminate,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_token_shards": op5_token_shards,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_collocations": op11_collocations,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_language_id": op13_language_id,
}

_FOLD = f"'{UPPER}', '{LOWER}'"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_FOLD})) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op2_url_filter": f"""
        WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_FOLD}) AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        r AS (SELECT *, '.' || host AS dotted FROM h),
        j AS (SELECT *, CASE
            WHEN ends_with(dotted, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
            WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
            WHEN ends_with(dotted, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN ends_with(dotted, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
            WHEN ends_with(dotted, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM r)
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
               CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM j""",
    "op3_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS g
               FROM i, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(k) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM iw),
        dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
               FROM d, sizes, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS u(k)),
        hits AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, g)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) AS u(p) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(all_items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_line_dedup": rf"""
        WITH l AS (SELECT doc_id, i, line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
                   unnest(lines) WITH ORDINALITY AS u(line, i)),
        k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_FOLD}) AS key FROM l),
        r AS (SELECT key, count(DISTINCT doc_id) AS n, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key),
        m AS (SELECT k.*, coalesce(n > 1 AND doc_id <> first_id, false) AS lost FROM k LEFT JOIN r USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op11_collocations": rf"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_FOLD}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
        f AS (SELECT lang, m, g, count(*) AS f
              FROM (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM w, range(1, 5) AS s(m), unnest(range(1, len(w) - m + 2)) AS u(i)) GROUP BY ALL),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        c AS (SELECT * FROM f WHERE m > 1 AND f >= 30),
        covered AS (SELECT DISTINCT s.lang, s.g FROM c AS s JOIN c AS b ON s.lang = b.lang AND b.m > s.m
                    AND contains(' ' || b.g || ' ', ' ' || s.g || ' ') AND 100::HUGEINT * b.f >= 80::HUGEINT * s.f),
        k AS (SELECT lang, m, g, f, string_split(g, ' ') AS w FROM c ANTI JOIN covered USING (lang, g)),
        cut AS (SELECT k.lang, k.g AS phrase, k.f AS a, u.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * k.f) // (l.f + r.f))::BIGINT AS score
                FROM k, unnest(range(1, m)) AS u(k) JOIN f AS l ON l.lang = k.lang AND l.g = array_to_string(k.w[1:u.k], ' ')
                JOIN f AS r ON r.lang = k.lang AND r.g = array_to_string(k.w[u.k + 1:], ' ')),
        low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM low JOIN n USING (lang) QUALIFY rank <= 2000""",
}
