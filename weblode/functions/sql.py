"""The scalar functions in SQL, as expressions that Catalyst inlines, and one table function for LATERAL joins."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F
from pyspark.sql.functions import udtf

from weblode.functions import urls as U

QUERY_PARAMS = r"""CASE WHEN contains(url, '?') THEN filter(transform(
    split(substring_index(substring(url, instr(url, '?') + 1), '#', 1), '&'),
    pair -> trim(BOTH ' \t\n\r' FROM substring_index(pair, '=', 1))), name -> name <> '') ELSE CAST(array() AS ARRAY<STRING>) END"""

# The trailing marks, taken off one by one: a closing parenthesis that some opening one belongs to stays, and all before it.
CLEAN_URL = r"""rtrim(' \t\n\r', aggregate(sequence(1, length(regexp_extract(url, '[.,;:!?)\\]}>\'"`]+\\z', 0)) + 1), url, (u, i) -> CASE
    WHEN u RLIKE '[.,;:!?\\]}>\'"`]\\z' OR (u LIKE '%)' AND length(u) - length(replace(u, '(', '')) < length(u) - length(replace(u, ')', ''))) THEN left(u, length(u) - 1) ELSE u END))"""


def _text(spark: SparkSession, make) -> str:
    """A column expression over `url` as SQL text."""
    frame = spark.createDataFrame([], "url string").select(make(F.col("url")).alias("x"))
    expression = frame._jdf.queryExecution().analyzed().expressions().head().children().head().sql()
    return expression.replace("spark_catalog.", "")


def register(spark: SparkSession) -> list[str]:
    """Creates categorize_url, is_valid_url, clean_url, query_params and the table function extract_urls for the session."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION clean_url(url STRING) RETURNS STRING RETURN {CLEAN_URL}")
    for name, kind, make in (("categorize_url", "STRING", U.categorize_url), ("is_valid_url", "BOOLEAN", U.is_valid_url)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(url STRING) RETURNS {kind} RETURN {_text(spark, make)}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION query_params(url STRING) RETURNS ARRAY<STRING> RETURN {QUERY_PARAMS}")
    spark.udtf.register("extract_urls", _table_function())
    return ["categorize_url", "is_valid_url", "clean_url", "query_params", "extract_urls"]


def _table_function():
    @udtf(returnType="url string, source_line int, detection_method string, confidence string, technique_id int")
    class ExtractUrls:
        """What the file type's parser and all techniques find in a content; for a column of contents joined laterally."""

        def eval(self, content: str, file_name: str, file_type: str):
            import numpy as np
            import pyarrow as pa

            from weblode.plans import engine

            if content:
                for h in engine.hits_in(pa.array([content]), np.array([file_type], dtype=object), range(1, 68)):
                    yield h[1], h[2], h[8], h[7], h[9]

    return ExtractUrls
