"""The pipeline's stages on the smallest tables, each against its operator's decisions, and the registered queries against SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from weblode.llm import decontamination, near_dedup, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if number < 4:
            assert docs.columns == columns
        if name == "toxicity":
            clean = toxicity.toxicity(before, labels).where(F.col("score") < toxicity.THRESHOLD)
            assert ids == {r.doc_id for r in clean.collect()}
        if name == "near_dedup":
            found = near_dedup.near_duplicates(before).collect()
            assert ids == {r.component_id for r in found} and docs.count() == len(ids)
        if name == "decontamination":
            leaks = {r.doc_id for r in decontamination.matches(before, bench).collect()}
            assert ids == {r.doc_id for r in before.collect()} - leaks
        if name == "source_mixing":
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
        if name == "token_output":
            rows = docs.orderBy("start").collect()
            assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
            assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert len(corpus_pipeline.STAGES) == 5


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "start", "n_tokens", "ids_crc32"} == set(rows[0].asDict())


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    with duckdb.connect() as con:
        for t in ("documents", "pages", "benchmark", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        relation = con.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in relation.description]
        expected = [tuple(r[names.index(c)] for c in columns) for r in relation.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in frame.select(*columns).collect()), key=key) == sorted(expected, key=key)


def test_run_against_brute_force(spark):
    """What the stages keep, tokenized text by text in id order."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    kept = sorted((r.doc_id, [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.select("doc_id", "text").collect())
    want, start = [], 0
    for doc_id, ids in kept:
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_pipeline_edges(spark, tmp_path):
    """Null ids, null and empty texts, repeated rows, an extra column of each odd name, and an empty table."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(1, "some plain words", "a"), (1, "some plain words", "a"), (None, "no id here at all", None), (3, None, "b"), (None, None, None), (5, "", "b"), (6, "x" * 50_000 + " y" * 5000, "a")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS __id", "'v' AS `a.b`", "2 AS row", "3 AS copies")
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        folder = str(tmp_path / name)
        labels.write.parquet(f"{folder}/labels.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        docs.write.parquet(f"{folder}/documents.parquet")
        found = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in found} <= {1, 3, 5, 6, None} and (name == "odd") == bool(found)
        ordered = sorted(found, key=lambda r: r.start)
        assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
