"""Session helpers of the training-data operators: inputs, lineage cuts, rows as one column."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weblode.llm import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    It is the one that `spark.checkpoint.dir` names. Where that is unset a session on one
    machine, as in tests, makes a temporary one; on a cluster nothing is written.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="weblode-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read back, so that a lost executor costs no lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def column(name: str) -> Column:
    """A column by its name as it is, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Each row as one struct `row`, with further columns made from it; no name of the table can clash with them."""
    return docs.select(F.struct(*map(column, docs.columns)).alias("row"), *(c.alias(n) for n, c in keys.items()))


def unpacked(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The rows' own columns again, named as in `like`."""
    return rows.select(*(F.col("row")[name].alias(name) for name in like.columns))


def kept(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose text passes; `keep` gives a mask over a bounded run of texts. All columns, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            for part in T.slices(pa.RecordBatch.from_arrays([rows, rows.field("text")], ["row", "text"]), "text"):
                yield pa.RecordBatch.from_arrays([part.column("row").filter(pa.array(keep(part.column("text"))))], ["row"])

    rows = packed(docs)
    return unpacked(rows.mapInArrow(run, rows.schema), docs)
