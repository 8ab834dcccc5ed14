"""Sources: landed JSON payloads of several shapes, line files, nested corpora, pages (SRC1-SRC16)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JOB = "job_id string, ats string, company_slug string, title string, location string, apply_url string, description string, department string, country string"

GREENHOUSE = (
    "jobs array<struct<id: bigint, title: string, location: struct<name: string>, absolute_url: string, content: string, "
    "metadata: array<struct<name: string, value: string>>, departments: array<struct<name: string>>>>"
)
LEVER = (
    "array<struct<id: string, text: string, hostedUrl: string, descriptionPlain: string, lists: array<struct<text: string, content: string>>, "
    "categories: struct<location: string, commitment: string, department: string, team: string>, workplaceType: string, country: string>>"
)
ASHBY = (
    "jobs array<struct<id: string, title: string, location: string, isRemote: boolean, jobUrl: string, applyUrl: string, descriptionHtml: string, "
    "descriptionPlain: string, department: string, team: string, employmentType: string, workplaceType: string, "
    "address: struct<postalAddress: struct<addressCountry: string>>>>"
)
SMARTRECRUITERS = (
    "totalFound int, content array<struct<id: string, name: string, location: struct<fullLocation: string, country: string>, company: struct<name: string>, "
    "function: struct<label: string>, department: struct<label: string>, typeOfEmployment: struct<label: string>, industry: struct<label: string>, experienceLevel: struct<label: string>>>"
)
WORKDAY = "total int, jobPostings array<struct<title: string, externalPath: string, locationsText: string, postedOn: string>>"


def _jobs(rows: DataFrame, ats: str, **columns: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    names = [c.split()[0] for c in JOB.split(", ")]
    held = {"ats": F.lit(ats), "company_slug": F.col("company_slug"), "description": F.lit(""), "location": F.lit("Unknown"), "apply_url": F.lit("")} | columns
    return rows.select(*(F.coalesce(held.get(c, null), F.lit("")).alias(c) if c in ("apply_url", "description") else held.get(c, null).alias(c) for c in names)).where(
        "coalesce(title, '') != ''"
    )


def greenhouse_jobs(payloads: DataFrame) -> DataFrame:
    """SRC1: (company_slug, payload) to job rows; a payload that isn't JSON gives none, a job without title is skipped."""
    j = payloads.select("company_slug", F.inline(F.from_json("payload", GREENHOUSE).jobs))
    return _jobs(
        j, "greenhouse", job_id=F.col("id").cast("string"), title=F.col("title"), location=F.coalesce("location.name", F.lit("Unknown")),
        apply_url=F.col("absolute_url"), description=F.col("content"), department=F.try_element_at(F.col("departments.name"), F.lit(1)),
    )


def lever_jobs(payloads: DataFrame) -> DataFrame:
    """SRC2: a flat list; the sections' texts join the description."""
    j = payloads.select("company_slug", F.inline(F.from_json("payload", LEVER)))
    sections = F.array_join(F.transform(F.coalesce("lists", F.from_json(F.lit("[]"), "array<struct<text: string, content: string>>")), lambda s: F.concat_ws("\n", s.text, strip_tags(s.content))), "\n\n")
    return _jobs(
        j, "lever", job_id=F.col("id"), title=F.col("text"), location=F.coalesce("categories.location", F.lit("Unknown")), apply_url=F.col("hostedUrl"),
        description=F.trim(F.concat_ws("\n\n", "descriptionPlain", sections)), department=F.col("categories.department"), country=F.col("country"),
    )


def ashby_jobs(payloads: DataFrame) -> DataFrame:
    """SRC3."""
    j = payloads.select("company_slug", F.inline(F.from_json("payload", ASHBY).jobs))
    return _jobs(
        j, "ashby", job_id=F.col("id"), title=F.col("title"), location=F.coalesce("location", F.lit("Unknown")), apply_url=F.coalesce("applyUrl", "jobUrl"),
        description=F.coalesce("descriptionPlain", strip_tags(F.col("descriptionHtml"))), department=F.col("department"), country=F.col("address.postalAddress.addressCountry"),
    )


def smartrecruiters_jobs(pages: DataFrame, blocked: list[str] = ()) -> DataFrame:
    """SRC4: pages of a listing are just rows; slugs that are blocked are not read."""
    j = pages.where(~F.col("company_slug").isin(*blocked) if blocked else F.lit(True)).select("company_slug", F.inline(F.from_json("payload", SMARTRECRUITERS).content))
    return _jobs(
        j, "smartrecruiters", job_id=F.col("id"), title=F.col("name"), location=F.coalesce("location.fullLocation", F.lit("Unknown")),
        apply_url=F.concat(F.lit("https://jobs.smartrecruiters.com/"), "company_slug", F.lit("/"), "id"), department=F.col("function.label"), country=F.col("location.country"),
    )


def workday_jobs(pages: DataFrame, keep: Column | None = None) -> DataFrame:
    """SRC5: listed rows, gated by title."""
    j = pages.select("company_slug", F.inline(F.from_json("payload", WORKDAY).jobPostings))
    rows = _jobs(j, "workday", job_id=F.col("externalPath"), title=F.col("title"), location=F.coalesce("locationsText", F.lit("Unknown")), apply_url=F.col("externalPath"))
    return rows.where(keep) if keep is not None else rows


def json_path(path: str) -> str:
    """A dotted path with [N] indices as a JSON path."""
    return "$" + "".join(p if p.startswith("[") else "." + p for p in path.replace("[", ".[").strip(".").split(".") if p)


def configured_jobs(payloads: DataFrame, source: dict) -> DataFrame:
    """SRC6, X30: a source that only its configuration describes: where the jobs, ids, titles and places are, and how URLs look."""
    fields = source["fields"]
    jobs = F.from_json(F.get_json_object("payload", json_path(fields["jobs_array"])), "array<string>")
    j = payloads.select(F.explode(jobs).alias("job"))
    value = lambda name: F.get_json_object("job", json_path(fields[name])) if fields.get(name) else F.lit(None).cast("string")
    url = F.replace(F.lit(fields.get("url_template", "")), F.lit("{id}"), F.coalesce(value("id"), F.lit("")))
    for name in [p.split("}")[0] for p in fields.get("url_template", "").split("{")[1:]]:
        if name != "id":
            url = F.replace(url, F.lit("{" + name + "}"), F.coalesce(F.get_json_object("job", json_path(name)), F.lit("")))
    return _jobs(
        j.withColumn("company_slug", F.lit(source["slug"])), "custom", job_id=F.concat(F.lit(source["slug"] + "_"), value("id")), title=value("title"),
        location=F.coalesce(value("location"), F.lit("Unknown")), apply_url=url,
    )


def newer_than(rows: DataFrame, column: str, cursor: int) -> DataFrame:
    """SRC7, ST1: rows after the cursor; what comes late is dropped silently, as the cursor says it was seen."""
    return rows.where(F.col(column) > cursor)


def index_slugs(lines: DataFrame, pattern: str, keep: Column | None = None) -> DataFrame:
    """SRC8: slugs of the URLs in lines of JSON; bad lines are skipped."""
    url = F.from_json("value", "url string", {"mode": "PERMISSIVE"}).url
    slugs = lines.select(F.lower(F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))).alias("slug")).where("slug IS NOT NULL").distinct()
    return slugs.where(keep) if keep is not None else slugs


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target))


def json_or_empty(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """SRC9: a JSON file with a given schema; missing or broken is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "DROPMALFORMED").json(path)


def first_that_has_rows(*frames: DataFrame) -> DataFrame:
    """SRC10, M21: the first frame that isn't empty, else the last."""
    for df in frames[:-1]:
        if not df.isEmpty():
            return df
    return frames[-1]


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC11: lines of JSON with a given schema; blank lines are no rows."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def tail(lines: DataFrame, order: str, skip: int) -> DataFrame:
    """SRC12: what comes after the first lines, by a line number that the rows carry."""
    return lines.where(F.col(order) > skip)


def flat_fields(corpus: DataFrame) -> DataFrame:
    """SRC13: (company, job_id, fields) to a row a field with its places (ci, fi)."""
    return corpus.select("ci", "company", "job_id", F.posexplode("fields").alias("fi", "field"))


def with_precedence(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """SRC14: many JSON files as one frame, each row with its file, by whose name precedence goes."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("file", F.input_file_name())


def page_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """SRC15: whole pages, compressed ones unpacked, with their SHA-1."""
    pages = spark.read.text(pattern, wholetext=True)
    return pages.select(F.input_file_name().alias("file"), F.sha1("value").alias("page_hash"))


class _Fields(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[dict] = []
        self.labels: dict[str, str] = {}
        self.open_label: str | None = None
        self.text = ""

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "label":
            self.open_label, self.text = a.get("for", ""), ""
        if tag in ("input", "select", "textarea"):
            row = {"tag": tag, "itype": a.get("type", tag), "name": a.get("name", ""), "id": a.get("id", ""), "ac": a.get("autocomplete", ""), "req": "required" in a, "placeholder": a.get("placeholder", ""), "inner": self.text.strip() if self.open_label == "" else ""}
            self.rows.append(row)

    def handle_data(self, data: str) -> None:
        if self.open_label is not None:
            self.text += data

    def handle_endtag(self, tag: str) -> None:
        if tag == "label" and self.open_label is not None:
            self.labels[self.open_label] = self.text.strip()
            self.open_label = None


FIELD = "tag string, itype string, name string, id string, ac string, req boolean, placeholder string, label string"


def page_fields(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """SRC16: the form fields of pages, in order, with the labels that stand for them."""
    kind = dict(pages.dtypes)[id_col]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, html in zip(pdf[id_col], pdf[html_col]):
                parser = _Fields()
                parser.feed(html or "")
                for fi, row in enumerate(parser.rows):
                    label = parser.labels.get(row["id"]) or row.pop("inner")
                    row.pop("inner", None)
                    out.append({"page": key, "fi": fi, **row, "label": label})
            yield pd.DataFrame(out, columns=["page", "fi", *[c.split()[0] for c in FIELD.split(", ")]])

    return pages.select(id_col, html_col).mapInPandas(read, f"page {kind}, fi int, {FIELD}")


def strip_tags(html: Column) -> Column:
    """Text of short HTML fragments without a parser: tags go, common entities are read."""
    text = F.regexp_replace(html, "(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, "[ \\t]+", " "))
