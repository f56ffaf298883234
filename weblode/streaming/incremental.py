"""The plan over a stream of documents: files as they arrive, each (method, URL) reported once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weblode.operators import relational
from weblode.plans.engine import all_hits
from weblode.sources.detect import file_type, is_binary
from weblode.sources.files import MAX_MEGABYTES


def watch_folder(spark: SparkSession, path: str, max_megabytes: int = MAX_MEGABYTES) -> DataFrame:
    """New files of a folder as (doc_ord, file_name, file_type, content, seen_at)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(path)
    plain = found.where(F.col("length") <= max_megabytes << 20).where(~is_binary(F.col("content")))
    name, text = F.regexp_replace("path", "^file:(?://)?", ""), F.make_valid_utf8(F.decode("content", "UTF-8"))
    return plain.select(
        F.unix_micros("modificationTime").alias("doc_ord"), name.alias("file_name"), file_type(name, F.lit(None).cast("string"), text).alias("file_type"),
        text.alias("content"), F.col("modificationTime").alias("seen_at"),
    ).where(F.length("content") > 0)


def new_results(docs: DataFrame, watermark: str | None = "1 day", techniques=range(1, 68)) -> DataFrame:
    """Valid results of a document stream (with `seen_at`); with a watermark each (method, URL) once within it."""
    hits = all_hits(docs.select("doc_ord", "file_name", "file_type", "content", "seen_at"), list(techniques))
    results = relational.with_category(relational.valid(hits))
    if watermark is None:
        return results
    return results.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["http_method", "url"])
