"""Where results go: category folders, JSON Lines, one JSON array, CSV and text."""

from __future__ import annotations

import contextlib
import os

from pyspark.sql import Column, DataFrame, functions as F

from weblode.functions import urls as U

CSV_COLUMNS = ("url", "source_file", "source_line", "detection_method", "http_method", "category", "confidence")


def text_line(methods: bool = False, params: bool = False, source: bool = False, debug: bool = False) -> Column:
    """`[METHOD] url [p1,p2] (file:line) {detection #id}`, each part on demand."""
    names = F.concat("query_params", "body_params")
    parts = [
        F.nullif(F.col("http_method"), F.lit("")) if methods else None,
        F.translate("url", "\r\n", ""),
        F.when(F.size(names) > 0, F.concat(F.lit("["), F.array_join(names, ","), F.lit("]"))) if params else None,
        F.concat(F.lit("("), F.col("source_file"), F.lit(":"), F.col("source_line").cast("string"), F.lit(")")) if source else None,
        F.concat(F.lit("{"), F.col("detection_method"), F.lit(" #"), F.col("technique_id").cast("string"), F.lit("}")) if debug else None,
    ]
    return F.concat_ws(" ", *(p for p in parts if p is not None))


def as_text(results: DataFrame, **parts: bool) -> DataFrame:
    return results.select(text_line(**parts).alias("value"))


def _json_columns() -> list[Column]:
    """Empty optional fields are null, so that JSON leaves them out."""
    none_if_empty = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return [
        F.col("url"), F.col("source_file"), F.col("source_line"), F.col("detection_method"), F.nullif(F.col("http_method"), F.lit("")).alias("http_method"),
        none_if_empty("query_params"), none_if_empty("body_params"), none_if_empty("headers"), F.col("category"), F.col("confidence"), F.col("technique_id"),
    ]


def full_json() -> Column:
    return F.to_json(F.struct(*_json_columns()))


def as_json(results: DataFrame) -> DataFrame:
    return results.select(*_json_columns())


def as_csv(results: DataFrame) -> DataFrame:
    return results.select(*CSV_COLUMNS)


def write_json_lines(results: DataFrame, path: str, mode: str = "error") -> None:
    as_json(results).write.mode(mode).json(path)


def write_csv(results: DataFrame, path: str, mode: str = "error") -> None:
    as_csv(results).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_text(results: DataFrame, path: str, mode: str = "error", **parts: bool) -> None:
    as_text(results, **parts).write.mode(mode).text(path)


def category_file() -> Column:
    """The list that a category's URLs go to; a category without one of its own is named after itself."""
    names = F.create_map(*(F.lit(x) for pair in U.CATEGORY_FILES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.col("category")), F.concat("category", F.lit(".txt")))


def write_category_folders(results: DataFrame, path: str, mode: str = "error", methods: bool = False) -> None:
    """One folder of text for each category present, named as its list (`category_file=api_endpoints.txt`), all URLs, and JSON Lines."""
    lines = results.select(category_file().alias("category_file"), text_line(methods=methods).alias("value"))
    lines.write.mode(mode).partitionBy("category_file").text(f"{path}/by_category")
    as_text(results).write.mode(mode).text(f"{path}/all_urls")
    write_json_lines(results, f"{path}/results", mode)


def write_files(results: DataFrame, path: str, methods: bool = False) -> dict[str, int]:
    """One local file for each category, all_urls.txt, and results.json as one array; the lines of each file.

    For results that a user reads: rows come to this machine a partition at a time, in order.
    """
    os.makedirs(path, exist_ok=True)
    lines = results.select(category_file().alias("file"), text_line(methods=methods).alias("line"), text_line().alias("url"), full_json().alias("json"))
    counts: dict[str, int] = {"all_urls.txt": 0}
    with contextlib.ExitStack() as stack:
        opened = {}

        def write(name: str, text: str) -> None:
            if name not in opened:
                opened[name] = stack.enter_context(open(os.path.join(path, name), "w", encoding="utf-8"))
            opened[name].write(text)

        write("all_urls.txt", "")
        write("results.json", "[")
        for row in lines.toLocalIterator(prefetchPartitions=True):
            counts[row["file"]] = counts.get(row["file"], 0) + 1
            write(row["file"], row["line"] + "\n")
            write("all_urls.txt", row["url"] + "\n")
            write("results.json", (",\n" if counts["all_urls.txt"] else "\n") + row["json"])
            counts["all_urls.txt"] += 1
        write("results.json", "\n]\n")
    return counts


def json_array(results: DataFrame) -> DataFrame:
    """One row holding all results as one JSON array; for results that fit one row."""
    rows = as_json(results)
    each = F.struct("category", "url", "http_method", F.to_json(F.struct(*rows.columns)).alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(each)), lambda r: r["line"])
    return rows.agg(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")).alias("value"))
