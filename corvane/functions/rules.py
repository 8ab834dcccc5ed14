"""Rule tables compiled into column expressions."""

from __future__ import annotations

import re
from re import _constants, _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a literal that texts are looked up by.
GRAM = 3


def any_word(keywords: list[str]) -> str:
    """A case-insensitive pattern for any of the keywords between word boundaries. A keyword that ends in a dot is
    met only where a word character follows it, as the boundary asks."""
    return r"(?iu)\b(?:" + "|".join(re.sub(r"([^\w\s/-])", r"\\\1", k) for k in keywords) + r")\b"


def all_matching(text: Column, table: dict[str, str]) -> Column:
    """Names of all patterns in the table that a text matches, in the table's order."""
    hits = F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in table.items()))
    return F.filter(hits, lambda x: x.isNotNull())


def first_matching(text: Column, table: list[tuple[str, list[str], list[str]]]) -> Column:
    """The first name one of whose patterns matches while none of its exclusions does; null without."""
    out = F
    for name, patterns, exclusions in table:
        hit = text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
        if exclusions:
            hit = hit & ~text.rlike("(?i)" + "|".join(f"(?:{p})" for p in exclusions))
        out = out.when(hit, name)
    return out.otherwise(F.lit(None).cast("string"))


def first_group(text: Column, table: list[tuple[str, str]]) -> Column:
    """(name, group 1) of the first pattern that matches with a group that isn't empty."""
    struct = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    found = [F.when(F.regexp_extract(text, p, 1) != "", struct(name, F.regexp_extract(text, p, 1))) for name, p in table]
    return F.coalesce(*found)


def literals(pattern: str) -> list[str] | None:
    """Texts of which any match of the pattern holds at least one, in lower case; None where the pattern has no such.

    A branch needs one for each of its ways. Of several that all matches hold, the longest is taken.
    """

    def best(ways: list[list[str]]) -> list[str] | None:
        usable = [w for w in ways if w and min(map(len, w)) >= GRAM]
        return max(usable, key=lambda w: (min(map(len, w)), -len(w)), default=None)

    def of(parts) -> list[str] | None:
        found, run = [], ""
        for op, value in [*parts, (None, None)]:
            if op is _constants.LITERAL:
                run += chr(value).lower()
                continue
            if run:
                found.append([run])
                run = ""
            if op is _constants.SUBPATTERN:
                found.append(of(value[3]))
            elif op is _constants.BRANCH:
                ways = [of(way) for way in value[1]]
                found.append(None if None in ways else [x for w in ways for x in w])
            elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0]:
                found.append(of(value[2]))
        return best(found)

    return of(_parser.parse(pattern))


def with_first_indexed(rows: DataFrame, text: Column, table: list[tuple[str, list[str], list[str]]], name: str) -> DataFrame:
    """As first_matching, for tables of any length: rows with one more column.

    Every rule's required literals are listed by one run of GRAM letters, of those they have the one that the fewest
    rules have. Distinct texts are cut into such runs and joined to the list; only the rules met so are checked, the
    literal first, then the patterns. Rules without a literal are tried on every text. text must be in lower case.
    """
    spark = rows.sparkSession
    own = rows.withColumn("__text", text)
    texts = own.select("__text").where("__text IS NOT NULL").distinct()
    listed, always = [], []
    for k, (_, patterns, _) in enumerate(table):
        needed = [literals(p) for p in patterns]
        if None in needed:
            always.append(k)
        else:
            listed += [(k, x) for ways in needed for x in dict.fromkeys(ways)]
    often: dict[str, int] = {}
    runs = {x: {x[i : i + GRAM] for i in range(len(x) - GRAM + 1)} for _, x in listed}
    for _, x in listed:
        for g in runs[x]:
            often[g] = often.get(g, 0) + 1
    joined = lambda ps: "(?i)" + "|".join(f"(?:{p})" for p in ps)
    posted = spark.createDataFrame([(min(runs[x], key=lambda g: (often[g], g)), k, x) for k, x in listed], "gram string, rule int, literal string")
    whole = spark.createDataFrame([(k, name_, joined(p), joined(x) if x else None) for k, (name_, p, x) in enumerate(table)], "rule int, name string, pattern string, exclusion string")
    grams = F.array_distinct(F.expr(f"transform(sequence(1, greatest(1, length(__text) - {GRAM - 1})), i -> substring(__text, i, {GRAM}))"))
    met = texts.select("__text", F.explode(grams).alias("gram")).join(posted, "gram").where(F.contains("__text", "literal")).select("__text", "rule")
    tried = met.distinct().join(whole, "rule").where(F.expr("__text RLIKE pattern AND NOT coalesce(__text RLIKE exclusion, false)")).select("__text", "rule", "name")
    for k in always:
        n, p, x = table[k]
        hit = F.col("__text").rlike(joined(p)) & (~F.col("__text").rlike(joined(x)) if x else F.lit(True))
        tried = tried.unionByName(texts.where(hit).select("__text", F.lit(k).alias("rule"), F.lit(n).alias("name")))
    first = tried.groupBy("__text").agg(F.min_by("name", "rule").alias(name))
    return own.join(first, "__text", "left").drop("__text")
