"""SimHash near-dedup over a Gray-order hierarchical index (op 10).

1. Each text gives one 64-bit SimHash fingerprint: the majority of the XXH64 bits of its
   shingles. Equal fingerprints are one node from here on, so a large group of exact
   copies costs one row.
2. Two fingerprints within `radius` bits agree on at least one of radius + 1 blocks of
   bits, the uppermost shared patterns of the index. Each fingerprint goes to the trees
   of its blocks; a tree with more than `tree_rows` fingerprints is split by the same
   argument on its remaining bits, so none grows with the corpus and no link is lost.
3. A task holds the trees of one cell, sorts each by Gray rank, factors shared masked bit
   patterns into upper nodes and searches from the root, pruning whole groups by
   accumulated differences. It returns only a spanning forest of the links found.
4. Components of the spanning links come from rounds of neighbour minimum and pointer
   jumping, each cut by a checkpoint.

Defined results: a null or blank text has fingerprint zero, linked like any other; rows with a
null id take part and get their component's id; the component id is the smallest non-null
id; repeated rows are in one component; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weblode.llm import hamming as H, text as T
from weblode.llm.spark_io import checkpointed, packed, unpacked

SHINGLE_WORDS = 3
RADIUS = 3
#: Fingerprints of one tree, and of one task's trees.
TREE_ROWS = 50_000
CELL_ROWS = 100_000
#: A fingerprint is frequent if more than this part of all rows have it; so there are never more frequent ones.
FREQUENT = 1024


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.slices(batch, "text"):
            words = T.cut_words(part.column("text"), lower=True)
            bits = simhash(words, shingle_words).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(bits)], ["doc_id", "text_key", "bits"])


def simhash(words: T.Words, k: int) -> np.ndarray:
    """SimHash of each row over its k-word shingles, space-joined; a shorter row is its own shingle."""
    # Words are laid out again with one space after each, so that a shingle is one span of bytes.
    size = words.ends - words.starts
    place = np.cumsum(size + 1) - (size + 1)
    packed = np.full(int((size + 1).sum()) + 8, 0x20, np.uint8)
    step = np.repeat(words.starts - place, size + 1) + np.arange(len(packed) - 8)
    inside = np.ones(len(step), bool)
    inside[place + size] = False
    packed[:-8][inside] = words.data[step[inside]]
    start = np.flatnonzero(T.within_rows(words.first, k))
    stop = start + k - 1
    few = np.flatnonzero((words.counts > 0) & (words.counts < k))
    start, stop = np.r_[start, words.first[few]], np.r_[stop, words.first[few + 1] - 1]
    order = np.argsort(start, kind="stable")
    start, stop = start[order], stop[order]
    hashes = H.xxh64_spans(packed, place[start], place[stop] + size[stop] - place[start])
    return H.majority_bits(hashes, np.searchsorted(start, words.first))


def _forest(group: pa.Table, radius: int) -> pa.Table:
    bits = group.column("bits").to_numpy().view(np.uint64)
    keys = group.column("tree").to_numpy()
    forest = H.GrayForest(keys, bits)
    parts = H.Components(len(bits))
    for leaf, low, high in forest.links(radius):
        size = high - low
        base = np.cumsum(size) - size
        parts.link(np.repeat(leaf, size), np.repeat(low - base, size) + np.arange(int(size.sum())))
    root = parts.roots()
    ordered = bits[forest.order].view(np.int64)
    joined = np.flatnonzero(root != np.arange(len(root)))
    return pa.table([ordered[joined], ordered[root[joined]]], ["a", "b"])


def _deeper(fixed: int, parts: int) -> list[int]:
    """The masks that fix one more of `parts` blocks of the bits still open."""
    free = [b for b in range(64) if not fixed >> b & 1]
    if len(free) < parts:
        return [(1 << 64) - 1]
    return [fixed | sum(1 << b for b in free[i * len(free) // parts : (i + 1) * len(free) // parts]) for i in range(parts)]


def _route(rows: DataFrame, paths: list[int], radius: int) -> tuple[DataFrame, list[int]]:
    """Copies each row into the trees of the next depth; the masks reached."""
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    turn, reached = None, []
    for fixed in paths:
        masks = _deeper(fixed, radius + 1)
        reached += masks
        to = F.array(*map(signed, masks))
        turn = F.when(F.col("fixed") == signed(fixed), to) if turn is None else turn.when(F.col("fixed") == signed(fixed), to)
    out = rows.select("bits", F.explode(turn).alias("fixed"))
    return out.withColumn("tree", F.xxhash64("fixed", F.col("bits").bitwiseAND(F.col("fixed")))), list(dict.fromkeys(reached))


def tree_keys(nodes: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(bits, tree): each distinct fingerprint in every tree it is searched in.

    A tree is the set of fingerprints that agree on some fixed bits. One over `tree_rows` is
    split: its open bits are cut into radius + 1 blocks, and two members within the radius
    agree on one of them. Depth d has (radius + 1)^d masks, whatever the data.
    """
    rows, paths = _route(nodes.select("bits", F.lit(0).cast("long").alias("fixed")), [0], radius)
    ready: list[DataFrame] = []
    while True:
        large = checkpointed(rows.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") > tree_rows).select("tree"))
        if large.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(large, "tree", "left_anti"))
        rows, paths = _route(rows.join(large, "tree", "left_semi"), paths, radius)
        rows = checkpointed(rows)
    out = ready[0].select("bits", "tree")
    for more in ready[1:]:
        out = out.unionByName(more.select("bits", "tree"))
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b): comp is the smallest node reachable."""
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp"))
    labels = checkpointed(labels)
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("low"))
        near = labels.join(heard, labels.node == heard.a).select("node", F.col("comp").alias("old"), F.least("comp", "low").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        moved = checkpointed(near.join(up, "comp").select("node", "old", F.least("comp", "up").alias("comp")))
        labels = moved.select("node", "comp")
        if moved.where(F.col("comp") != F.col("old")).isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, tree_rows: int = TREE_ROWS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(doc_id, text_key, bits, component_id, component): the fingerprint as a signed long, and its component's smallest id and node."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    prints = checkpointed(texts.mapInArrow(lambda batches: _fingerprints(batches, shingle_words), "doc_id long, text_key long, bits long"))
    nodes = checkpointed(prints.groupBy("bits").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")))
    total = nodes.agg(F.sum("times")).first()[0] or 0
    cells = max(32, -(-nodes.count() * (radius + 1) // cell_rows))
    routed = tree_keys(nodes, radius, tree_rows).withColumn("cell", F.pmod(F.xxhash64("tree"), F.lit(cells)))
    links = routed.groupBy("cell").applyInArrow(lambda group: _forest(group, radius), "a long, b long")
    member = components(links)
    ids = member.join(nodes, member.node == nodes.bits).groupBy("comp").agg(F.min("first").alias("id"))
    joined = member.join(ids, "comp").select(F.col("node").alias("bits"), "id", "comp")
    resolved = nodes.join(joined, "bits", "left").select(
        "bits", F.coalesce("id", "first").alias("component_id"), F.coalesce("comp", "bits").alias("component"), (F.col("times") * FREQUENT > total).alias("frequent")
    )
    resolved = checkpointed(resolved)
    # Rows of a frequent fingerprint stay where they are and look theirs up; only the others are dealt by fingerprint.
    few, rest = F.broadcast(resolved.where("frequent")), resolved.where("NOT frequent")
    met = prints.join(few, "bits").unionByName(prints.join(few.select("bits"), "bits", "left_anti").join(rest, "bits"))
    return met.select("doc_id", "text_key", "bits", "component_id", "component")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component: that of the smallest id (nulls last). All columns, whatever their names."""
    found = near_duplicates(docs, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("kept")
    kept = found.groupBy("component").agg(first).select("kept.doc_id", "kept.text_key")
    rows = packed(docs, own_id=docs["doc_id"].cast("long"), own_key=F.xxhash64(docs["text"]))
    met = rows.join(kept, rows["own_id"].eqNullSafe(kept["doc_id"]) & (rows["own_key"] == kept["text_key"]))
    order = Window.partitionBy("own_id", "own_key").orderBy(F.xxhash64("row"))
    return unpacked(met.withColumn("n", F.row_number().over(order)).where("n = 1"), docs)


def fingerprint_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")
