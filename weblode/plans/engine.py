"""The whole plan: documents in, one row for each distinct (method, URL) out.

    documents -> parser, inline scripts, 67 techniques (one Arrow UDF, one explode)
              -> validation, filters -> first-wins dedup -> category -> order

A document's content goes to Python once, is parsed once, and comes back as one array of hits;
validation and filters read only the URL and run below the dedup's shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from weblode.functions.scan import Texts, arrow_hits, sliced
from weblode.operators import parsers, registry, relational
from weblode.sources.detect import file_type

#: Stage of the techniques over a whole document: after its parser (0) and its inline scripts (1, 2, ...).
WHOLE = 1 << 30
RESULT = ("url", "source_file", "source_line", "detection_method", "http_method", "query_params", "body_params", "headers", "category", "confidence", "technique_id")
FOUND_TYPE = ArrayType(StructType([*parsers.PARSED_TYPE.elementType.fields, StructField("stage", IntegerType())]))


def documents(raw: DataFrame, ord_column: str, name: str, content: str, content_type: str | None = None) -> DataFrame:
    """(doc_ord, file_name, file_type, content) from any table of texts; empty contents yield nothing and are left out."""
    text = F.col(content)
    kind = file_type(F.col(name), F.col(content_type) if content_type else F.lit(None).cast("string"), text)
    found = raw.select(F.col(ord_column).alias("doc_ord"), F.col(name).alias("file_name"), kind.alias("file_type"), text.alias("content"))
    return found.where(F.length("content") > 0)


def spread(docs: DataFrame) -> DataFrame:
    """A scan's rows over all cores, where it has fewer partitions than there are: extraction costs far more than moving them.

    For plain scans only, whose partitions are known without running anything.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _parsed(texts: Texts, kinds: np.ndarray, rows: list[tuple]) -> tuple[list[tuple[int, int]], Texts]:
    """Adds the parsers' hits (stage 0); returns (document, number from 1) and text of each inline script of HTML, from the same parse."""
    owners, scripts = [], []
    for doc in np.flatnonzero((kinds == "html") & (texts.sizes > 0)).tolist():
        page = parsers.page(texts.text(doc))
        rows += [(*h, 0) for h in parsers.as_hits(doc, page.rows)]
        owners += [(doc, n) for n in range(1, len(page.scripts) + 1)]
        scripts += [s["content"] for s in page.scripts]
    for kind, find in parsers.FINDERS.items():
        some = np.flatnonzero(kinds == kind)
        if kind != "html" and len(some):
            rows += [(int(some[h[0]]), *h[1:], 0) for h in find(Texts(texts.contents.take(pa.array(some))))]
    return owners, Texts(pa.array(scripts, pa.large_string()))


def hits_in(contents: pa.Array, kinds: np.ndarray, techniques: Iterable[int], with_parsers: bool = True) -> list[tuple]:
    """Every hit of some contents of the given file types, in the order of stages; technique and stage stand at its end."""
    texts, chosen, rows = Texts(contents), {t: registry.TECHNIQUES[t] for t in techniques}, []
    if with_parsers:
        owners, scripts = _parsed(texts, kinds, rows)
        for t, technique in chosen.items():
            rows += [(owners[h[0]][0], *h[1:], t, owners[h[0]][1]) for h in technique.find(scripts)]
    for t, technique in chosen.items():
        rows += [(*h, t, WHOLE) for h in technique.find(texts)]
    return rows


def found(content: Column, kind: Column, techniques: Iterable[int] = range(1, 68), with_parsers: bool = True) -> Column:
    """All hits of a document, as an array of structs with technique and stage."""
    chosen = tuple(techniques)

    def run(contents: pa.Array, kinds: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = np.asarray(kinds.to_pylist(), dtype=object)
        part = lambda contents, where: arrow_hits(len(contents), hits_in(contents, kinds[where], chosen, with_parsers), ("technique_id", "stage"))
        return sliced(contents, part, to_arrow_type(FOUND_TYPE))

    return F.arrow_udf(run, FOUND_TYPE)(F.make_valid_utf8(content), kind)


def all_hits(docs: DataFrame, techniques: Iterable[int] = range(1, 68), with_parsers: bool = True) -> DataFrame:
    """Every hit before dedup: (doc_ord, stage, match_ord, source_file, hit columns) and the documents' other columns."""
    others = [c for c in docs.columns if c not in ("doc_ord", "file_name", "file_type", "content")]
    hits = found(F.col("content"), F.col("file_type"), techniques, with_parsers)
    rows = docs.select("doc_ord", F.col("file_name").alias("source_file"), *others, F.posexplode(hits).alias("match_ord", "hit"))
    return rows.select("doc_ord", "match_ord", "source_file", *others, "hit.*")


def extract(docs: DataFrame, scope: str = "", exclude: str = "", include: str = "", techniques: Iterable[int] = range(1, 68), with_parsers: bool = True, sort: bool = True) -> DataFrame:
    """The results relation of documents (doc_ord, file_name, file_type, content)."""
    hits = relational.valid(all_hits(docs, list(techniques), with_parsers))
    kept = relational.first_wins(relational.filtered(hits, scope, exclude, include))
    results = relational.with_category(kept).withColumn("headers", F.create_map().cast("map<string,string>")).select(*RESULT)
    return relational.ordered(results) if sort else results
