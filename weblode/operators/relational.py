"""Operators over the results relation: first-wins dedup, validation, filters, order, summaries."""

from __future__ import annotations

import sys

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, Window, functions as F

from weblode.functions import urls as U

# Categories in the order that a summary shows them; all others are one line.
SHOWN = ("api_endpoint", "page_route", "static_asset", "external_service", "internal_infra", "websocket", "cloud_resource", "source_map")


def _order() -> tuple:
    """Document order: the argument's or table's, then names folder by folder; then stage and match."""
    return F.col("doc_ord"), F.translate("source_file", "/", "\x01"), F.col("stage"), F.col("match_ord")


def valid(results: DataFrame) -> DataFrame:
    """Results whose URL passes the thirteen rules; native, so Catalyst moves it below a window over the URL."""
    return results.where(U.is_valid_url(F.col("url")))


def first_wins(results: DataFrame, order: tuple | None = None) -> DataFrame:
    """One result for each (method, URL): the first in document, stage and match order.

    Spark keeps the first of each partition before the shuffle (a window group limit), so a
    URL found in most documents is no hot key.
    """
    first = Window.partitionBy("http_method", "url").orderBy(*(order or _order()))
    return results.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def _compiles(results: DataFrame, pattern: str, what: str) -> bool:
    """Whether the engine that is to run the pattern takes it; if not, says so."""
    try:
        results.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as error:
        print(f"[error] invalid {what} pattern {pattern!r}: {error}", file=sys.stderr)
        return False
    return True


def filtered(results: DataFrame, scope: str = "", exclude: str = "", include: str = "") -> DataFrame:
    """Scope (contained text), then exclude, then include; a pattern that does not compile is reported and skipped."""
    if scope:
        results = results.where(F.col("url").contains(scope))
    if exclude and _compiles(results, exclude, "exclude"):
        results = results.where(~F.col("url").rlike(exclude))
    if include and _compiles(results, include, "include"):
        results = results.where(F.col("url").rlike(include))
    return results


def ordered(results: DataFrame) -> DataFrame:
    return results.orderBy("category", "url", "http_method")


def with_category(results: DataFrame) -> DataFrame:
    """The URL's own category where the technique gave none."""
    return results.withColumn("category", F.coalesce("category", U.categorize_url(F.col("url"))))


def category_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(F.count("*").alias("urls"))


def summary_lines(results: DataFrame) -> DataFrame:
    """(place, category, urls): the categories in their fixed order, the others as one line at the end."""
    place = F.array_position(F.array(*map(F.lit, SHOWN)), F.col("category")).cast("int")
    shown = results.select(F.when(place > 0, place).otherwise(len(SHOWN) + 1).alias("place"), F.when(place > 0, F.col("category")).otherwise("other").alias("category"))
    return shown.groupBy("place", "category").agg(F.count("*").alias("urls"))


def totals(docs: DataFrame, results: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row (processed, urls, errors): inputs read or tried, results, and inputs left out."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = one(docs, "read").crossJoin(one(results, "urls")).crossJoin(one(rejected, "errors"))  # three single rows
    return counts.select((F.col("read") + F.col("errors")).alias("processed"), "urls", "errors")


def technique_summary(results: DataFrame) -> DataFrame:
    """Counts by technique and confidence with their subtotals."""
    return results.rollup("technique_id", "confidence").agg(F.count("*").alias("urls"), F.countDistinct("url").alias("distinct_urls"))


def unseen(results: DataFrame, earlier: DataFrame) -> DataFrame:
    """Results whose (method, URL) an earlier run has not got."""
    return results.join(earlier.select("http_method", "url").distinct(), ["http_method", "url"], "left_anti")
