"""Document sources: files, folders, URL lists, fetched URLs and standard input, in that order of the input list.

What cannot be read does not end a run: it becomes a row (file_name, reason) of the rejects.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weblode.sources import http
from weblode.sources.detect import EXTENSIONS, file_type, is_binary

DOCUMENTS = "doc_ord long, file_name string, file_type string, content string"
REJECTED = "file_name string, reason string"
# Folders that hold no sources of their own.
SKIPPED_FOLDERS = ("node_modules", "vendor", "__pycache__")
MAX_MEGABYTES = 100
#: Room for the documents of one argument in the order of all documents; within a folder the names decide.
STEP = 1 << 48


@dataclass
class Inputs:
    """The documents of a run, and what was left out and why."""

    docs: DataFrame
    rejected: DataFrame


def located(spark: SparkSession, path: str) -> str | None:
    """The full name of a file or folder, or None if there is none."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = name.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(name).toString() if system.exists(name) else None


def _literal(path: str) -> str:
    """The path for a reader that would expand patterns in it."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def _shown(path: Column | str) -> Column:
    return F.regexp_replace(path, "^file:(?://)?", "")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(line, url) of a list file; blank lines and comments (# or //) are left out."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim("value", F.lit(" \t\n\r\f\x0b")).alias("url"))
    return lines.where("url <> '' AND NOT startswith(url, '#') AND NOT startswith(url, '//')")


def _limit(max_megabytes: int) -> int:
    return (max_megabytes if max_megabytes > 0 else 10) << 20


def _binary(spark: SparkSession, paths: list[str], recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load([_literal(p) for p in paths])


def _plain(files: DataFrame, max_megabytes: int) -> DataFrame:
    # `length` is pushed to the source: contents over the limit are never read.
    small = files.where(F.col("length") <= _limit(max_megabytes))
    return small.select("path", _shown("path").alias("file_name"), "content").where(~is_binary(F.col("content")))


def files(spark: SparkSession, paths: list[str], max_megabytes: int = MAX_MEGABYTES) -> DataFrame:
    """(position, file_name, content) of single files that are there and neither too large nor binary, each once."""
    places = {full: i for i, full in reversed(list(enumerate(located(spark, p) for p in paths))) if full}
    if not places:
        return spark.createDataFrame([], "position long, file_name string, content binary")
    known = spark.createDataFrame(list(places.items()), "path string, position long")
    return _plain(_binary(spark, list(places), False), max_megabytes).join(F.broadcast(known), "path").select("position", "file_name", "content")


def _sources(found: DataFrame, root: str) -> DataFrame:
    """The files below a folder that are of known type, those of hidden and dependency folders left out."""
    below = F.substring("path", F.lit(len(root.rstrip("/")) + 1), F.length("path"))
    skipped = below.rlike(r"/(?:\.[^/]*|" + "|".join(SKIPPED_FOLDERS) + ")/")
    return found.where(F.lower("path").rlike(r"\.(?:" + "|".join(EXTENSIONS) + r")\z") & ~skipped)


def folder(spark: SparkSession, path: str, max_megabytes: int = MAX_MEGABYTES) -> DataFrame:
    """(file_name, content) of a folder's files of known type, hidden and dependency folders left out."""
    root = located(spark, path)
    if root is None:
        return spark.createDataFrame([], "file_name string, content binary")
    return _plain(_sources(_binary(spark, [root], True), root), max_megabytes).select("file_name", "content")


def rejected(spark: SparkSession, paths: list[str], max_megabytes: int = MAX_MEGABYTES, folders: Iterable[str] = ()) -> DataFrame:
    """(file_name, reason) of the files that `files` and `folder` leave out: missing, too large, binary."""
    gone = [(p, "not found") for p in (*paths, *folders) if located(spark, p) is None]
    parts = [spark.createDataFrame(gone, REJECTED)]
    single = [full for p in paths if (full := located(spark, p))]
    found = [_binary(spark, single, False)] if single else []
    found += [_sources(_binary(spark, [root], True), root) for d in folders if (root := located(spark, d))]
    for part in found:
        # Only what passes the limit is read to see whether it is binary.
        large = part.where(F.col("length") > _limit(max_megabytes)).select(_shown("path").alias("file_name"), F.lit("too large").alias("reason"))
        binary = part.where(F.col("length") <= _limit(max_megabytes)).where(is_binary(F.col("content")))
        parts += [large, binary.select(_shown("path").alias("file_name"), F.lit("binary").alias("reason"))]
    return functools.reduce(DataFrame.unionByName, parts)


def text(spark: SparkSession, content: str, name: str = "stdin") -> DataFrame:
    return spark.createDataFrame([(name, content)], "file_name string, content string")


def stdin(spark: SparkSession) -> DataFrame | None:
    """Standard input as one document; None at a terminal or when empty."""
    if sys.stdin is None or sys.stdin.isatty():
        return None
    content = sys.stdin.read()
    return text(spark, content) if content else None


def read_inputs(
    spark: SparkSession,
    urls: Iterable[str] = (),
    lists: Iterable[str] = (),
    paths: Iterable[str] = (),
    folders: Iterable[str] = (),
    raw: str | None = None,
    max_megabytes: int = MAX_MEGABYTES,
    timeout: float = 10,
) -> Inputs:
    """All inputs as documents (doc_ord, file_name, file_type, content), and what was left out.

    doc_ord follows the arguments: URLs, lists line by line, files, folders, standard input. Files of
    a folder have one doc_ord; among them the names decide, folder by folder, as of `relational.first_wins`.
    """
    rejects = [spark.createDataFrame([], REJECTED)]
    parts: list[DataFrame] = []  # (position within the argument, file_name, content_type, content)
    wanted = [u.strip() for u in urls if u.strip()]
    asked = [spark.createDataFrame(list(enumerate(wanted)), "line long, url string")] if wanted else []
    for path in lists:
        if located(spark, path) is None:
            rejects.append(spark.createDataFrame([(path, "not found")], REJECTED))
        else:
            asked.append(url_list(spark, path))
    for found in asked:
        fetched = http.fetch(found.groupBy("url").agg(F.min("line").alias("line")), timeout)
        body = fetched.where(F.col("body").isNotNull())
        parts.append(body.select(F.col("line").alias("position"), F.col("url").alias("file_name"), "content_type", F.col("body").alias("content")).where(~is_binary(F.col("content"))))
        rejects.append(fetched.where(F.col("body").isNull()).select(F.col("url").alias("file_name"), F.coalesce("error", F.lit("no body")).alias("reason")))
        rejects.append(body.where(is_binary(F.col("body"))).select(F.col("url").alias("file_name"), F.lit("binary").alias("reason")))
    named, folders = [p.strip() for p in paths if p.strip()], list(folders)
    first = F.lit(0).cast("long").alias("position")
    local = ([files(spark, named, max_megabytes)] if named else []) + [folder(spark, p, max_megabytes).select(first, "file_name", "content") for p in folders]
    if named or folders:
        rejects.append(rejected(spark, named, max_megabytes, folders))
    if raw is not None:
        local.append(text(spark, raw).select(first, "file_name", F.encode("content", "UTF-8").alias("content")))
    parts += [p.withColumn("content_type", F.lit(None).cast("string")) for p in local]
    left_out = functools.reduce(DataFrame.unionByName, rejects)
    if not parts:
        return Inputs(spark.createDataFrame([], DOCUMENTS), left_out)
    content = F.make_valid_utf8(F.decode("content", "UTF-8"))
    numbered = [p.select((F.lit(i * STEP) + F.col("position")).alias("doc_ord"), "file_name", "content_type", content.alias("content")) for i, p in enumerate(parts)]
    every = functools.reduce(DataFrame.unionByName, numbered).where(F.length("content") > 0)
    return Inputs(every.select("doc_ord", "file_name", file_type(F.col("file_name"), F.col("content_type"), F.col("content")).alias("file_type"), "content"), left_out)


def collect(spark: SparkSession, *args, **options) -> DataFrame:
    """The documents of `read_inputs`."""
    return read_inputs(spark, *args, **options).docs
