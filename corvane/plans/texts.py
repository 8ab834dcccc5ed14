"""Text transforms on the supplied tables."""

from __future__ import annotations

from html import entities

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import places, text
from corvane.plans.base import NOW, Tables, query


def now():
    return F.lit(NOW).cast("timestamp")


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


#: Titles that parts and customers stand for, so that the rules have something to find.
_TITLE = """CASE p_size % 8 WHEN 0 THEN 'Software Engineer Intern' WHEN 1 THEN 'Senior Data Engineer' WHEN 2 THEN 'Data Analyst Co-op' WHEN 3 THEN 'Internal Auditor'
    WHEN 4 THEN 'Marketing Intern' WHEN 5 THEN p_type WHEN 6 THEN 'Nursing apprentice' ELSE p_name END"""
_BODY = "CASE WHEN p_size % 3 = 0 THEN 'You build data pipelines with our data engineer team' ELSE 'benefits and perks' END"


@query("P1_title_gate", f"""
    WITH t AS (SELECT p_partkey, {_TITLE} AS title FROM part)
    SELECT p_partkey, NOT regexp_matches(title, '(?i)\\b(?:{"|".join(k.replace(".", chr(92) + ".") for k in text.EXCLUDED_TITLES)})\\b')
           AND len(list_intersect(regexp_extract_all(lower(title), '[a-z0-9\\-]+'), [{_quoted(text.ROLE_TOKENS)}])) > 0 AS kept FROM t""")
def title_gate(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.is_role(F.expr(_TITLE)).alias("kept"))


def _category_sql(column: str) -> str:
    cases = ", ".join(
        f"CASE WHEN regexp_matches({column}, '(?i)\\b(?:{'|'.join(words)})\\b') THEN '{name}' END" for name, words in text.CATEGORY_KEYWORDS.items()
    )
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@query("X2_multi_label_rules", f"""
    WITH t AS (SELECT p_partkey, {_TITLE} AS title, {_BODY} AS body FROM part), m AS (SELECT *, {_category_sql("title")} AS own, {_category_sql("title || ' ' || body")} AS every FROM t)
    SELECT p_partkey, array_to_string(CASE WHEN len(own) > 0 THEN own ELSE every END, ',') AS categories FROM m""")
def multi_label_rules(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(text.categories(F.expr(_TITLE), F.expr(_BODY)), ",").alias("categories"))


_YOE = """CASE l_linenumber % 5 WHEN 0 THEN 'needs ' || l_quantity::INT || '+ years of relevant experience' WHEN 1 THEN '2-' || l_quantity::INT || ' years experience'
    WHEN 2 THEN '3 to 5 Years of working experience or 9 years experience' WHEN 3 THEN 'no numbers' ELSE NULL END"""
_YOE_PATTERN = text.EXPERIENCE.replace("(?iU)", "(?i)")


@query("X1_yoe_extract", f"""
    WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, {_YOE} AS body FROM lineitem WHERE l_quantity < 60),
    r AS (SELECT *, nullif(regexp_extract(body, '{_YOE_PATTERN}', 1), '') AS a, nullif(regexp_extract(body, '{_YOE_PATTERN}', 2), '') AS b, nullif(regexp_extract(body, '{_YOE_PATTERN}', 3), '') AS c FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(a, c)::INT AS yoe_min, b::INT AS yoe_max FROM r""")
def yoe_extract(t: Tables) -> DataFrame:
    body = F.expr(_YOE.replace("l_quantity::INT", "cast(l_quantity AS int)"))
    rows = t.lineitem.where("l_quantity < 60").select("l_orderkey", "l_linenumber", "l_partkey", text.experience_years(F.lit(None).cast("string"), body).alias("y"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("y.min").alias("yoe_min"), F.col("y.max").alias("yoe_max"))


@query("X3_X4_department_categories", """
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'sales' WHEN p_size % 3 = 1 THEN 'sales,software_engineering' ELSE 'sales' END AS categories FROM part""")
def department_categories(t: Tables) -> DataFrame:
    from corvane.operators.merge import append_missing

    names = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("Unlisted"), F.lit(" SALES "))).when(F.col("p_size") % 3 == 1, F.array(F.lit("Unlisted"), F.lit("Engineering"), F.lit("Legal"))).otherwise(F.array(F.lit("Operations")))
    mapped = append_missing(F.array(F.lit("sales")), text.category_of_departments(names))
    return t.part.select("p_partkey", F.array_join(mapped, ",").alias("categories"))


@query("X5_metadata_values", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Full-time' WHEN event_id % 3 = 1 THEN 'Part-time' END AS employment_type,
           CASE WHEN event_id % 2 = 0 THEN '10.0' END AS salary_min FROM events""")
def metadata_values(t: Tables) -> DataFrame:
    entry = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    kind = F.when(F.col("event_id") % 3 == 0, "Full-time").when(F.col("event_id") % 3 == 1, "null").otherwise("")
    later = F.when(F.col("event_id") % 3 == 1, "Part-time")
    metadata = F.array(entry("Team", F.lit("A")), entry("Employment Type", kind), entry("Worker Type", later))
    pay = F.when(F.col("event_id") % 2 == 0, '{"unit": "USD", "min_value": "10.0", "max_value": "12.0"}').otherwise('{"unit": "USD", "min_value": "0.0", "max_value": "0.0"}')
    return t.events.select(
        "event_id", text.first_value(metadata, text.METADATA_NAMES["employment_type"]).alias("employment_type"), text.salary_range(pay)["min_value"].alias("salary_min")
    )


@query("X6_country_codes", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 > 0 THEN upper(substr(trim(n_name), 1, 2)) END AS code FROM nation")
def country_codes(t: Tables) -> DataFrame:
    raw = F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), F.lower(F.substring("n_name", 1, 2))))
    return t.nation.select("n_nationkey", places.country_of_code(raw).alias("code"))


#: Pages cut into scripts, styles, comments, tags and text between them, for SQL.
_PIECES = r"regexp_extract_all(coalesce(html, ''), '(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<[^>]*>|[^<]+')"
_UNESCAPED = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
#: White space of Python's strip and of its patterns, as characters and as a class.
_WHITE = " || ".join(f"chr({k})" for k in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
_WHITE_CLASS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: Character references by the rule of HTML 5, as the parser reads them in text: names also without their semicolon where the standard knows them so, the
#: longest of them, and numbers. SIGNS gives a map from all references in pages that stand for something else, SIGNED a text with them replaced.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_NAMES = ", ".join("('" + name + "', '" + sign.replace("'", "''") + "')" for name, sign in sorted(entities.html5.items()))
_WINDOWS = ", ".join(f"({128 + k}, '{bytes([128 + k]).decode('cp1252')}')" for k in range(32) if k not in (1, 13, 15, 16, 29))
_SIGNS = rf"""names(name, sign) AS (VALUES {_NAMES}), windows(n, sign) AS (VALUES {_WINDOWS}),
    refs AS (SELECT DISTINCT unnest(regexp_extract_all(html, '{_REFERENCE}')) AS ref FROM pages),
    digits AS (SELECT ref, lower(ref[3]) = 'x' AS hex, ltrim(rtrim(ltrim(ref[3:], 'xX'), ';'), '0') AS d FROM refs WHERE starts_with(ref, '&#')),
    numbers AS (SELECT ref, CASE WHEN d = '' THEN 0 WHEN length(d) > 8 THEN 1114112 WHEN hex THEN ('0x' || d)::BIGINT ELSE d::BIGINT END AS n FROM digits),
    signs AS (SELECT ref, CASE WHEN w.sign IS NOT NULL THEN w.sign WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n IN (13, 129, 141, 143, 144, 157) THEN chr(n::INT)
                  WHEN n BETWEEN 1 AND 8 OR n IN (11, 127) OR n BETWEEN 14 AND 31 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(n::INT) END AS sign FROM numbers LEFT JOIN windows w USING (n)
              UNION ALL SELECT ref, arg_max(e.sign || substr(ref, length(name) + 2), length(name)) FROM refs JOIN names e ON ref[2:] = name OR (NOT ends_with(name, ';') AND starts_with(ref, '&' || name))
              WHERE NOT starts_with(ref, '&#') GROUP BY ref),
    known AS (SELECT map_from_entries(list((ref, sign))) AS known FROM signs)"""
_SIGNED = f"array_to_string(list_transform(regexp_extract_all({{}}, '{_REFERENCE.replace('{', '{{').replace('}', '}}')}|[^&]+|&'), lambda y: coalesce(known[y], y)), '')"


@query("X7_page_text", rf"""
    WITH {_SIGNS},
    p AS (SELECT page_id, list_transform({_PIECES}, lambda x: CASE WHEN regexp_matches(x, '^<(script|style)>') THEN regexp_replace(x, '(?s)^<[a-z]+>(.*)</[a-z]+>$', '\1')
                      WHEN starts_with(x, '<') THEN '' ELSE {_SIGNED.format("x")} END) AS parts FROM pages, known)
    SELECT page_id, trim(regexp_replace(array_to_string(list_filter(list_transform(parts, lambda x: trim(x, {_WHITE})), lambda x: x <> ''), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), {_WHITE}) AS body FROM p""")
def page_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.page_text("html").alias("body"))


@query("X8_visible_text", rf"""
    WITH {_SIGNS},
    p AS (SELECT page_id, list_transform(list_filter({_PIECES}, lambda x: NOT starts_with(x, '<')), lambda x: trim({_SIGNED.format("x")}, {_WHITE})) AS parts FROM pages, known)
    SELECT page_id, trim(regexp_replace(array_to_string(list_filter(parts, lambda x: x <> ''), ' '), '{_WHITE_CLASS}+', ' ', 'g')) AS body FROM p""")
def visible_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.visible_text("html").alias("body"))


@query("X9_named_link", rf"""
    WITH l AS (SELECT page_id, list_zip(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)', 1), regexp_extract_all(html, '<a href="([^"]*)">([^<]*)', 2)) AS links FROM pages)
    SELECT page_id, coalesce({_UNESCAPED.format("list_filter(links, lambda x: contains(" + _UNESCAPED.format("x[2]") + ", 'a'))[1][1]")}, '') AS href FROM l""")
def named_link(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.link_named("a")("html").alias("href"))


@query("X10_display_name", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '3D Systems ' || s_suppkey ELSE 'Acme Co ' || s_suppkey END AS name FROM supplier""")
def display_name(t: Tables) -> DataFrame:
    slug = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("3d-systems-"), "s_suppkey")).otherwise(F.concat(F.lit("acme-co-"), "s_suppkey"))
    return t.supplier.select("s_suppkey", text.display_name(slug).alias("name"))


@query("X11_slug_candidates", """
    WITH n AS (SELECT s_suppkey, lower(s_name) || ' & sons, inc.' AS base, lower(s_name) || ' & sons' AS bare FROM supplier)
    SELECT s_suppkey, array_to_string([trim(regexp_replace(bare, '[^a-z0-9]+', '-', 'g'), '-'), regexp_replace(bare, '[^a-z0-9]+', '', 'g'),
           trim(regexp_replace(base, '[^a-z0-9]+', '-', 'g'), '-'), regexp_replace(base, '[^a-z0-9]+', '', 'g')], ',') AS slugs FROM n""")
def slug_candidates(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.array_join(text.slug_candidates(F.concat("s_name", F.lit(" & Sons, Inc. "))), ",").alias("slugs"))


@query("X12_bare_domain", """
    SELECT page_id, nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^www\\.', '')), '') AS domain FROM pages""")
def bare_domain(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.bare_domain(F.col("url")).alias("domain"))


_ATS_URL = """CASE page_id % 6 WHEN 0 THEN 'https://boards.greenhouse.io/Acme' || page_id || '?x=1' WHEN 1 THEN 'https://jobs.lever.co/acme/' || page_id WHEN 2 THEN 'https://acme.wd1.myworkdayjobs.com/en'
    WHEN 3 THEN 'https://boards-api.greenhouse.io/v1/boards/acme' || page_id || '/jobs' WHEN 4 THEN url ELSE NULL END"""


@query("X13_ats_of_url", f"""
    WITH u AS (SELECT page_id, {_ATS_URL} AS apply FROM pages)
    SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'workday' WHEN 3 THEN 'greenhouse' END AS ats,
           CASE page_id % 6 WHEN 0 THEN 'acme' || page_id WHEN 1 THEN 'acme' WHEN 2 THEN 'wd1' WHEN 3 THEN 'acme' || page_id END AS slug FROM u""")
def ats_of_url(t: Tables) -> DataFrame:
    found = t.pages.select("page_id", text.ats_of_url(F.expr(_ATS_URL)).alias("d"))
    return found.select("page_id", F.col("d.ats").alias("ats"), F.col("d.slug").alias("slug"))


@query("X14_ats_of_page", """
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'lever' WHEN 1 THEN 'greenhouse' END AS ats, CASE page_id % 3 WHEN 0 THEN 'acme' || page_id END AS slug FROM pages""")
def ats_of_page(t: Tables) -> DataFrame:
    added = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<a href="https://jobs.lever.co/Acme'), "page_id", F.lit('/1">'))).when(F.col("page_id") % 3 == 1, "<p>boards.greenhouse.io</p>").otherwise("")
    found = t.pages.select("page_id", text.ats_of_page(F.concat("html", added)).alias("d"))
    return found.select("page_id", F.col("d.ats").alias("ats"), F.col("d.slug").alias("slug"))


_KEYWORDS = f"list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]*(?:-[a-z][a-z0-9]+)*'), lambda t: length(t) > 2 AND NOT list_contains([{_quoted(text.STOP_WORDS)}], t))"


@query("X15_keyword_extract", f"SELECT item_id, array_to_string(list_sort(list_distinct({_KEYWORDS})), ' ') AS keywords FROM benchmark")
def keyword_extract(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(F.array_sort(text.keywords(F.col("text"))), " ").alias("keywords"))


@query("X16_keyword_presence", f"""
    WITH k AS (SELECT conv_id, turn, array_distinct({_KEYWORDS}) AS ks FROM conversations),
    p AS (SELECT k.*, lower(c.text) AS low FROM k JOIN conversations c ON c.conv_id = k.conv_id AND c.turn = k.turn + 1)
    SELECT conv_id, turn, len(list_filter(ks, lambda x: contains(low, x) OR (contains(x, '-') AND contains(low, replace(x, '-', ' ')))))::INT AS n_present, len(ks)::INT AS n_all FROM p""")
def keyword_presence(t: Tables) -> DataFrame:
    """Each turn's keywords in the whole text of the next turn."""
    asked = t.conversations.select("conv_id", "turn", text.keywords(F.col("text")).alias("ks"))
    said = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("body"))
    rows = asked.join(said, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.size(text.keyword_split(F.col("ks"), F.col("body"))["present"]).alias("n_present"), F.size("ks").alias("n_all"))


@query("X17_technical_terms", f"""
    WITH w AS (SELECT doc_id, unnest(array_distinct(string_split(text, ' '))) AS w FROM documents)
    SELECT doc_id, count(*) FILTER (lower(w) IN ({_quoted(text.TECHNOLOGIES)}) OR contains(w, '-') OR (upper(w) = w AND lower(w) <> w AND length(w) >= 2) OR regexp_matches(w, '[0-9]')
           OR regexp_matches(lower(w), '(?:{"|".join(text.TECH_ENDINGS)})$')) AS n FROM w GROUP BY doc_id""")
def technical_terms(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    return words.groupBy("doc_id").agg(F.count(F.when(text.is_technical(F.col("w")), 1)).alias("n"))


@query("X18_keyword_inject")
def keyword_inject(t: Tables) -> DataFrame:
    terms = F.filter(text.keywords(F.col("text")), lambda k: text.is_technical(k))
    return t.documents.select("doc_id", text.inject_keywords(F.concat(F.lit("Skills: SQL\n"), F.col("text")), terms).alias("text"))


@query("X19_format_lint", r"""
    WITH d AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 1 THEN chr(10) || 'Page 1 of 2' WHEN 2 THEN chr(10) || ' - 3 - ' WHEN 3 THEN chr(10) || 'a' || chr(9) || chr(9) || 'b |c|' WHEN 4 THEN chr(10) || 'page' || chr(10) || '1 of 2' ELSE '' END AS text FROM documents),
    w AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n,
          list_filter(['awards', 'certifications', 'education', 'experience', 'objective', 'projects', 'skills', 'summary'], lambda x: contains(lower(text), x)) AS found FROM d),
    i AS (SELECT doc_id, [CASE WHEN n < 200 THEN 'too sparse: ' || n || ' words' WHEN n > 1200 THEN 'too long: ' || n || ' words' END,
          CASE WHEN len(found) < 3 THEN 'sections found: ' || len(found) || '; missing: ' || array_to_string(list_filter(['awards', 'certifications', 'education', 'experience', 'objective', 'projects', 'skills', 'summary'], lambda x: NOT list_contains(found, x)), ', ') END,
          CASE WHEN regexp_matches(text, '\S[^\n]*\t\t[^\n]*\S') THEN 'columns: tabs within a line' END, CASE WHEN regexp_matches(text, '\|[^\n]*\|') THEN 'table: pipes within a line' END,
          CASE WHEN regexp_matches(text, '(?i)\bpage[ \t]+\d+[ \t]+of[ \t]+\d+\b') OR regexp_matches(text, '(?m)^[ \t]*-[ \t]*\d+[ \t]*-[ \t]*$') THEN 'page number' END] AS all_ FROM w)
    SELECT doc_id, array_to_string(list_filter(all_, lambda x: x IS NOT NULL), ' | ') AS issues FROM i""")
def format_lint(t: Tables) -> DataFrame:
    """All messages over whole texts, to which page marks, tabs and pipes are added here and there."""
    added = F.element_at(F.array(*map(F.lit, ("", "\nPage 1 of 2", "\n - 3 - ", "\na\t\tb |c|", "\npage\n1 of 2"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = t.documents.select("doc_id", F.concat("text", added).alias("text"))
    return rows.select("doc_id", F.array_join(text.format_issues(F.col("text")), " | ").alias("issues"))


@query("X20_bullet_rewrites", r"""
    WITH a AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
    b AS (SELECT doc_id, CASE WHEN contains(x, '* the') THEN left(x, strpos(x, '* the') - 1) || 'this' || substr(x, strpos(x, '* the') + 5) ELSE regexp_replace(x, '(?m)^([\s\-•*–]+)the', '\1this') END AS x FROM a)
    SELECT doc_id, CASE WHEN contains(x, 'and ') THEN left(x, strpos(x, 'and ') - 1) || 'or ' || substr(x, strpos(x, 'and ') + 4) ELSE regexp_replace(x, '(?m)^([\s\-•*–]+)and', '\1or ') END AS text FROM b""")
def bullet_rewrites(t: Tables) -> DataFrame:
    change = F.array(F.struct(F.lit("* the").alias("old"), F.lit("this").alias("new")), F.struct(F.lit("and ").alias("old"), F.lit("or ").alias("new")))
    return t.documents.select("doc_id", text.apply_rewrites(F.col("text"), change).alias("text"))


@query("X21_json_in_text", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS found FROM events")
def json_in_text(t: Tables) -> DataFrame:
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("x "), "props", F.lit(" y"))).otherwise("no { json }")
    return t.events.select("event_id", text.json_in(said).alias("found"))


@query("X22_payload_hash", "SELECT conv_id, turn, sha256(text) AS payload_hash FROM conversations")
def payload_hash(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.sha2("text", 256).alias("payload_hash"))


@query("X23_identity_hash", """
    SELECT n_nationkey, lower(to_hex(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(n_name || '|' || n_nationkey, ''), lambda c: ascii(c)::BIGINT)),
           lambda h, c: (h * 33 + c) & 4294967295))) AS h FROM nation""")
def identity_hash(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", text.identity_hash(F.col("n_name"), F.col("n_nationkey").cast("string")).alias("h"))


@query("X24_class_fingerprint", r"""
    SELECT page_id, substr(sha256(array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<([a-z]+)', 1))), '|')), 1, 16) AS fingerprint FROM pages""")
def class_fingerprint(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.class_fingerprint(F.regexp_extract_all("html", F.lit("<([a-z]+)"), F.lit(1))).alias("fingerprint"))


@query("X25_normal_label", r"""
    SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || '* #' || p_size), '[*✱]', '', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS label,
           CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'email' END AS stem FROM part""")
def normal_label(t: Tables) -> DataFrame:
    label = text.normal_label(F.concat("p_name", F.lit("* #"), "p_size"))
    stem = text.id_stem(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("form-question_"), "p_size")).otherwise(F.concat(F.lit("Email-"), "p_size")), ["question"])
    return t.part.select("p_partkey", label.alias("label"), stem.alias("stem"))


@query("X26_days_since", f"""
    SELECT o_orderkey, greatest(0, floor((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(o_orderdate)) / 86400000))::BIGINT AS days, (isodow(o_orderdate) - 1)::INT AS weekday FROM orders""")
def days_since(t: Tables) -> DataFrame:
    days = text.days_since(F.unix_millis(F.col("o_orderdate").cast("timestamp")), now())
    return t.orders.select("o_orderkey", days.alias("days"), F.weekday("o_orderdate").alias("weekday"))


@query("X27_relative_time", """
    SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' minute' || (CASE WHEN s // 60 = 1 THEN '' ELSE 's' END) || ' ago'
    WHEN s < 86400 THEN (s // 3600) || ' hour' || (CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END) || ' ago' ELSE (s // 86400) || ' day' || (CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END) || ' ago' END AS said
    FROM (SELECT event_id, (event_id * event_id * 7) % 900000 AS s FROM events)""")
def relative_time(t: Tables) -> DataFrame:
    s = (F.col("event_id") * F.col("event_id") * 7) % 900000
    return t.events.select("event_id", text.relative_time(F.unix_millis(now()) - s * 1000, now()).alias("said"))


@query("X28_salary_midpoint", "SELECT p_partkey, floor((p_size * 1000 + (p_size + 3) * 1000 + 1) / 2 + 0.5)::BIGINT AS midpoint FROM part")
def salary_midpoint(t: Tables) -> DataFrame:
    said = F.concat(F.lit("pays $"), F.format_number(F.col("p_size") * 1000, 0), F.lit(" – $"), F.format_number((F.col("p_size") + 3) * 1000 + 1, 0), F.lit(" a year"))
    return t.part.select("p_partkey", text.salary_midpoint(said).alias("midpoint"))


@query("X29_grade_bands", """
    SELECT c_custkey, CASE WHEN g >= 3.5 THEN '3.5-4.0' WHEN g >= 3.0 THEN '3.0-3.49' WHEN g >= 2.5 THEN '2.5-2.99' ELSE 'below 2.5' END AS band FROM (SELECT c_custkey, 2 + (c_custkey % 21) / 10.0 AS g FROM customer)""")
def grade_bands(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.element_at(text.grade_synonyms(2 + (F.col("c_custkey") % 21) / 10), 1).alias("band"))


@query("X30_url_template", "SELECT s_suppkey, 'https://x.example/jobs/' || s_suppkey || '?n=' || s_name AS url FROM supplier")
def url_template(t: Tables) -> DataFrame:
    url = F.replace(F.replace(F.lit("https://x.example/jobs/{id}?n={name}"), F.lit("{id}"), F.col("s_suppkey").cast("string")), F.lit("{name}"), F.col("s_name"))
    return t.supplier.select("s_suppkey", url.alias("url"))


@query("P14_compact_projection", """
    SELECT p_partkey, lower(p_brand) AS h, 'input' AS tag, p_name AS label, p_size > 25 AS req FROM part""")
def compact_projection(t: Tables) -> DataFrame:
    fields = F.array(F.struct(F.lower("p_brand").alias("field_id_hash"), F.lit("input").alias("tag"), F.struct(F.col("p_name").alias("label")).alias("field_semantics"), (F.col("p_size") > 25).alias("required")))
    compact = F.transform(fields, lambda f: F.struct(f["field_id_hash"].alias("h"), f["tag"].alias("tag"), f["field_semantics"]["label"].alias("label"), f["required"].alias("req")))
    return t.part.select("p_partkey", F.inline(compact))


@query("P12_page_triage", """
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'real' WHEN p_size % 3 = 1 THEN 'junk' ELSE 'uncertain' END AS bucket FROM part""")
def page_triage(t: Tables) -> DataFrame:
    from corvane.operators.filters import triage

    fields = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("Upload Resume"))).when(F.col("p_size") % 3 == 1, F.array("p_brand")).otherwise(F.array("p_brand", "p_type", "p_name", F.lit("x")))
    return t.part.select("p_partkey", triage(fields, ["resume", "cv upload"]).alias("bucket"))


@query("P15_known_categories", """
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'sales,sales' ELSE 'sales' END AS categories FROM part""")
def known_categories(t: Tables) -> DataFrame:
    from corvane.operators.filters import known_only

    said = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("sales"), F.lit("nonsense"), F.lit("sales"))).otherwise(F.array(F.lit("sales"), F.col("p_brand")))
    return t.part.select("p_partkey", F.array_join(known_only(said, list(text.CATEGORY_KEYWORDS)), ",").alias("categories"))
