"""The 67 techniques: their table and, for any set of them, their hits as an expression over a content column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weblode.functions import scan
from weblode.operators import calls, comments, config, encoded, hosts, lexical, routers

TECHNIQUES = lexical.TECHNIQUES | calls.TECHNIQUES | routers.TECHNIQUES | config.TECHNIQUES | hosts.TECHNIQUES | comments.TECHNIQUES | encoded.TECHNIQUES
NAMES = tuple(TECHNIQUES[t].name for t in sorted(TECHNIQUES))
# The techniques of each layer, first and last.
LAYERS = {1: (1, 14), 2: (15, 33), 3: (34, 40), 4: (41, 49), 5: (50, 53), 6: (54, 59), 7: (60, 67)}
EXPRESSIONS = {t: scan.column({t: technique}) for t, technique in TECHNIQUES.items()}


def layer_of(technique: int) -> int:
    return next(n for n, (a, b) in LAYERS.items() if a <= technique <= b)


def techniques(spark: SparkSession) -> DataFrame:
    """(id, name, layer, enabled) of every technique."""
    return spark.createDataFrame([(i, n, layer_of(i), True) for i, n in enumerate(NAMES, 1)], "id int, name string, layer int, enabled boolean")


def hits_of(content: Column, technique: int) -> Column:
    """The technique's hits in one content, with its id: array of structs."""
    return EXPRESSIONS[technique](content)


def apply(docs: DataFrame, technique: int, content: str = "content") -> DataFrame:
    """One technique as a table: a row for each hit, with the document's other columns."""
    kept = [c for c in docs.columns if c != content]
    return docs.select(*kept, F.inline(hits_of(F.col(content), technique)))
