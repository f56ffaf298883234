"""Mixing sources to target weights by pivotal dependent rounding (op 4).

Targets: sources in order weigh by a repeating list and share `epochs` of all words; no source
exceeds `most` times its own, and what it cannot take is shared again by weight. A source's
rate (target over size) is at most 2, so each of its documents is copied the rate's integer
part, plus once more with the fractional part as its probability.

Rounding: a pivotal step pairs two units and transfers expected words between them at
random until one's probability is 0 or 1; the other carries on. Neither a unit's expected
copies nor the sum of expected words ever changes, so the words taken differ from the
target by less than the one document left open at the end. Inside a bucket of bounded
rows documents are paired from the largest to the smallest, so what stays open is small as a
rule. Each bucket leaves at most one; these residuals meet in a reduction tree, `fan`
buckets a node, until one is left for each source and the last draw decides it. Draws are
hashes of the two documents, so reruns agree.

Defined results: a null text or one without words has size 0, target share like the others and
takes 0 words; null sources are one source, last in order; null ids and repeated rows are
rows like any other (rows equal in all columns are told apart by their copy number); an empty
table gives an empty result; a source of size 0 has target 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weblode.llm import text as T
from weblode.llm.spark_io import checkpointed, packed, unpacked

WEIGHTS = (5, 2, 1)
EPOCHS = 1.5
MOST = 2.0
#: Rows rounded in one bucket, and buckets joined in a node of the reduction tree.
BUCKET_ROWS = 4096
FAN = 64
#: A probability this near to 0 or 1 is integral.
TINY = 1e-9
#: Up to so many sources are planned on the driver, and the plan is broadcast; more are planned as a table.
DRIVER_SOURCES = 100_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> list[float]:
    """Each source's target words, in the sources' order."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    # A source is full as soon as a share for each unit of weight reaches this; full ones raise the others' share.
    order = sorted((i for i, n in enumerate(sizes) if n > 0), key=lambda i: most * sizes[i] / weight[i])
    words, free, full = sum(sizes), sum(weight[i] for i in order), 0
    found, share = [0.0] * len(sizes), 0.0
    for at, i in enumerate(order):
        share = (epochs * words - most * full) / free
        if share * weight[i] < most * sizes[i]:
            for k in order[at:]:
                found[k] = share * weight[k]
            break
        found[i] = most * sizes[i]
        full, free = full + sizes[i], free - weight[i]
    return found


def placed(per_source: DataFrame) -> DataFrame:
    """The sources with their place in code-point order, null last; sorted by ranges, so no task holds all of them."""
    ranked = checkpointed(per_source.orderBy(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    sizes = sorted((r["part"], r["count"]) for r in ranked.groupBy(part.alias("part")).count().collect())  # a row for each task
    before = dict(zip((p for p, _ in sizes), [sum(n for _, n in sizes[:i]) for i in range(len(sizes))], strict=True))
    bases = per_source.sparkSession.createDataFrame(list(before.items()), "part long, base long")
    found = ranked.withColumn("part", part).join(F.broadcast(bases), "part")
    return found.select("source", "source_size", "rows", (F.col("base") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def target_table(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> DataFrame:
    """(source, source_size, rows, place, target): as `targets`, for any number of sources, by rounds over a table."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sized = checkpointed(placed(per_source).withColumn("weight", weight))
    words, n_full, share = int(sized.agg(F.sum("source_size")).first()[0] or 0), -1, 0.0
    while True:  # the set of full sources grows with each round and is the same as in the order of filling
        full = (F.col("source_size") == 0) | (F.lit(share) * F.col("weight") >= most * F.col("source_size"))
        now = sized.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("source_size"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if now["n"] == n_full or not now["free"]:
            break
        n_full, share = now["n"], (epochs * words - most * int(now["full"] or 0)) / int(now["free"])
    return sized.withColumn("target", F.when(full, most * F.col("source_size")).otherwise(F.lit(share) * F.col("weight"))).drop("weight")


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.slices(batch, "text"):
            counts = T.cut_words(part.column("text")).counts.astype(np.int64)
            kept = [part.column(n) for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts)], [*(n for n in part.schema.names if n != "text"), "size"])


def _uniform(a: int, b: int, seed: int) -> float:
    """A number in (0, 1) from two row keys."""
    mask = (1 << 64) - 1
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9 + 0x27D4EB2F165667C5) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    x ^= x >> 31
    return ((x >> 11) + 0.5) / float(1 << 53)


def pivot(keys: list[int], shares: list[float], sizes: list[int], seed: int) -> tuple[list[int | None], int | None, float]:
    """One pass of pivotal steps over units in falling order of size.

    A step moves word mass between the open unit and the next one, up or down with the odds
    that keep both expectations, until one of the two is 0 or 1. Returns each unit's 0 or 1
    (None: still open), and the open unit with its probability.
    """
    out: list[int | None] = [None] * len(keys)
    at, p = None, 0.0
    for i, (key, q, size) in enumerate(zip(keys, shares, sizes, strict=True)):
        if q < TINY or q > 1.0 - TINY:
            out[i] = int(q > 0.5)
        elif size == 0:  # no mass to move
            out[i] = int(_uniform(key, 0, seed) < q)
        elif at is None:
            at, p = i, q
        else:
            s = sizes[at]
            up, down = min((1.0 - p) * s, q * size), min(p * s, (1.0 - q) * size)
            move = up if _uniform(keys[at], key, seed) * (up + down) < down else -down
            p, q = p + move / s, q - move / size
            for unit, x in ((at, p), (i, q)):
                if x < TINY or x > 1.0 - TINY:
                    out[unit] = int(x > 0.5)
            if out[at] is not None:
                at, p = (i, q) if out[i] is None else (None, 0.0)
    return out, at, p


def pivot_pool(keys: list[int], share: float, sizes: list[int], seed: int) -> tuple[list[int | None], int | None, float]:
    """`pivot` over units of equal probability."""
    return pivot(keys, [share] * len(keys), sizes, seed)


def _round_buckets(seed: int, last: bool):
    """Rounds each bucket; with `last` the residual is drawn too."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "row_key"], ascending=False, kind="stable")
        keys = [int(k) & ((1 << 64) - 1) for k in group["row_key"]]
        shares, sizes = group["share"].tolist(), group["size"].tolist()
        out, at, p = pivot(keys, shares, sizes, seed)
        if at is not None and last:
            out[at] = int(_uniform(keys[at], 0, seed) < p)
        extra = [-1 if x is None else x for x in out]
        share = [p if x is None else float(x) for x in out]
        return group.assign(extra=extra, share=share)[["place", "bucket", "origin", "row_key", "size", "share", "extra"]]

    return run


_STATE = "place long, bucket long, origin long, row_key long, size long, share double, extra int"


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST, seed: int = 17, bucket_rows: int = BUCKET_ROWS, fan: int = FAN) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_key"), "text")
    counted = checkpointed(texts.mapInArrow(word_counts, "doc_id long, source string, text_key long, size long"))
    per_source = counted.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    per_source = checkpointed(per_source)
    spark = docs.sparkSession
    if per_source.count() <= DRIVER_SOURCES:
        listed = sorted(per_source.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
        aims = targets([r["source_size"] for r in listed], weights, epochs, most)
        plan = spark.createDataFrame(
            [(r["source"], int(r["source_size"]), int(r["rows"]), i, aim) for i, (r, aim) in enumerate(zip(listed, aims, strict=True))],
            "source string, source_size long, rows long, place long, target double",
        )
        plan = F.broadcast(plan)
    else:
        plan = checkpointed(target_table(per_source, weights, epochs, most))
    most_buckets = max(1, -(-int(per_source.agg(F.max("rows")).first()[0] or 0) // bucket_rows))
    rows = counted.join(plan, counted["source"].eqNullSafe(plan["source"])).select(
        "doc_id", counted["source"], "text_key", "size", "source_size", "target", "place",
        F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket_rows)).cast("long").alias("buckets"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )
    # Rows equal in everything are numbered within their own group of equals, counted map-side first.
    same = ["doc_id", "source", "text_key", "size", "source_size", "target", "place", "buckets", "rate"]
    rows = rows.groupBy(*same).agg(F.count("*").alias("times")).select(*same, F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy"))
    whole = F.floor(F.col("rate") + 1e-9)
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text_key", "place", "copy", F.lit(seed))).withColumn("base", whole).withColumn("share", F.greatest(F.lit(0.0), F.col("rate") - whole))
    rows = checkpointed(rows.withColumn("bucket", F.pmod(F.xxhash64("row_key", F.lit(seed)), F.col("buckets"))))
    state = checkpointed(rows.select("place", "bucket", F.col("bucket").alias("origin"), "row_key", "size", "share").groupBy("place", "bucket").applyInPandas(_round_buckets(seed, False), _STATE))
    settled = [state.where("extra >= 0")]
    left = state.where("extra < 0")
    while True:
        most_buckets = -(-most_buckets // fan)
        last = most_buckets == 1
        left = left.withColumn("bucket", F.floor(F.col("bucket") / fan))
        joined = left.drop("extra").groupBy("place", "bucket").applyInPandas(_round_buckets(seed + most_buckets, last), _STATE)
        if last:
            settled.append(joined)
            break
        joined = checkpointed(joined)
        settled.append(joined.where("extra >= 0"))
        left = joined.where("extra < 0")
    decided = settled[0]
    for more in settled[1:]:
        decided = decided.unionByName(more)
    # Keys are compared within a bucket's rows only, where 64 bits tell them apart.
    decided = decided.select("place", F.col("origin").alias("bucket"), "row_key", F.col("extra").alias("one"))
    copies = (F.col("base") + F.col("one")).cast("long")
    met = rows.join(decided, ["place", "bucket", "row_key"])
    return met.select("doc_id", "source", "text_key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken. All columns, whatever their names."""
    taken = mix(docs, **options).groupBy("doc_id", "source", "text_key").agg(F.sort_array(F.collect_list("copies")).alias("copies"))
    rows = packed(docs, own_id=docs["doc_id"].cast("long"), own_source=docs["source"].cast("string"), own_key=F.xxhash64(docs["text"]))
    met = rows.join(taken, rows["own_id"].eqNullSafe(taken["doc_id"]) & rows["own_source"].eqNullSafe(taken["source"]) & (rows["own_key"] == taken["text_key"]))
    # Rows equal in id, source and text share their group's copies out among them.
    nth = F.row_number().over(Window.partitionBy("own_id", "own_source", "own_key").orderBy(F.xxhash64("row")))
    copies = met.withColumn("n", nth).withColumn("times", F.get("copies", F.col("n") - 1).cast("int")).where("times > 0")
    return unpacked(copies.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times")))), docs)
