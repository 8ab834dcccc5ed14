"""Form fields of pages as a table function for SQL (SRC16).

register(spark) makes it known:

    SELECT p.page_id, f.* FROM pages AS p, LATERAL form_fields(p.html) AS f
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corvane.sources.readers import FIELD, _Fields


class FormFields:
    """A row for each input, select and textarea of a page, in order, with the label that stands for it."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        if html.dataType.simpleString() not in ("string", "void"):
            raise ValueError(f"form_fields takes a page's HTML as a string, not {html.dataType.simpleString()}")
        kinds = {"string": StringType(), "boolean": BooleanType()}  # where this runs there is no session to read a schema's text
        schema = StructType().add("fi", IntegerType())
        for name, kind in (c.split() for c in FIELD.split(", ")):
            schema = schema.add(name, kinds[kind])
        return AnalyzeResult(schema)

    def eval(self, html: str) -> Iterator[tuple]:
        parser = _Fields()
        parser.feed(html or "")
        names = [c.split()[0] for c in FIELD.split(", ")][:-1]
        for fi, row in enumerate(parser.rows):
            yield (fi, *(row[n] for n in names), parser.labels.get(row["id"]) or row["inner"])


def register(spark: SparkSession) -> None:
    spark.udtf.register("form_fields", udtf(FormFields, useArrow=True))
