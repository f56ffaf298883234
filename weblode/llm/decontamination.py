"""Benchmark decontamination by SimHash over item-sized windows (op 2).

For an item of n words every n-word window of every document is a candidate copy. Words are
lower-cased (A-Z); a text is its multiset of k-word shingles, k = min(5, n), and the weighted
similarity of two is sum(min) / sum(max) of the multiplicities.

1. *Screen* (exact): two n-word texts reach similarity s only with an overlap of
   2 s / (1 + s) of their n - k + 1 shingles, so windows that hold fewer benchmark shingles
   than the least of their length's needs cannot match anything.
2. *Fingerprint.* What is left gets a 64-bit SimHash, and the items of that length are
   looked up through a multi-index: of three blocks of bits, fingerprints within `radius` agree
   on one up to a third of it. Items are filed under every value a few bits off their own,
   windows ask for every value a few bits off theirs, and the two together span that third, so
   all fingerprints within the radius are found; of unrelated ones some 4 in 100 are looked at.
3. *Verify.* Every candidate's weighted similarity is computed exactly.

At similarity 0.8 the expected distance is 9.7 of 64 bits (standard deviation 2.9); the radius
of 17 leaves two and a half deviations at that least similarity, and more above it.

The benchmark is worked off in parts of at most PART_CHARS characters, one pass over the
documents each and only one on the driver at a time, so its size is no limit; with several
parts each one's result is cut off by a checkpoint.

Defined results: null or blank texts and items match nothing; an item of fewer than 5 words
matches where its words stand in order; repeated rows are reported once each; null ids are
kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weblode.llm import hamming as H, text as T
from weblode.llm.spark_io import checkpointed, kept

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 17
BLOCKS = 3
PART_CHARS = 4 << 20
#: Values that the items of a part are filed under, all in all: the fewer items, the more bits off each is filed, and
#: the fewer values a window asks for.
FILED = 8 << 20
#: Shingles verified, and lookups made, at once.
CHUNK = 1 << 20
SCREEN_BITS = 22
SCHEMA = "doc_id long, item_id long, similarity double, start_word int, n_words int, windows int"


def as_sets(shingles: np.ndarray) -> np.ndarray:
    """Rows of shingles as sorted rows of distinct values: a shingle's second, third ... occurrence is one of its own."""
    rows = np.sort(shingles, axis=1)
    place = np.broadcast_to(np.arange(rows.shape[1]), rows.shape)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    nth = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    return np.sort(T.mix64(rows + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), axis=1)


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted similarity, sum(min) / sum(max), of each row of `as_sets` with its partner of equal size."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    common = (both[:, 1:] == both[:, :-1]).sum(axis=1)
    return common / (2 * a.shape[1] - common)


@functools.cache
def masks(width: int, radius: int) -> np.ndarray:
    """All patterns of at most so many bits among the lowest `width`."""
    return np.array([sum(1 << b for b in some) for n in range(radius + 1) for some in itertools.combinations(range(width), n)], np.uint32)


@dataclass
class Items:
    """The items of one length: ids, shingles, and a multi-index over their fingerprints."""

    n_words: int
    k: int
    ids: list
    shingles: np.ndarray | list  # a row an item, as of `as_sets`
    prints: np.ndarray
    need: int  # least overlap, in shingles, of a match
    in_part: int = 0  # items of all lengths that are filed beside these

    def __post_init__(self):
        self.filed: dict[int, list] = {}

    def reach(self, radius: int) -> tuple[int, int]:
        """Bits off that items are filed, and that windows ask for: together what a block may differ by."""
        block = radius // BLOCKS
        inner = max(i for i in range(block + 1) if i == 0 or max(self.in_part, len(self.prints)) * BLOCKS * len(masks(22, i)) <= FILED)
        return inner, block - inner

    def __getstate__(self):  # the index is built where it is used
        return self.__dict__ | {"filed": {}}

    def _blocks(self, radius: int) -> list[tuple]:
        """For each block: its cut, values of items and of those a few bits off, sorted, with the items of each."""
        if radius not in self.filed:
            inner, _ = self.reach(radius)
            self.filed[radius] = []
            for i in range(BLOCKS):
                low, high = 64 * i // BLOCKS, 64 * (i + 1) // BLOCKS
                own = _block(self.prints, low, high)[:, None] ^ masks(high - low, inner)
                order = np.argsort(own, axis=None, kind="stable")
                values, first = np.unique(own.ravel()[order], return_index=True)
                self.filed[radius].append((low, high, values, np.append(first, len(order)), (order // own.shape[1]).astype(np.int32)))
        return self.filed[radius]

    def candidates(self, prints: np.ndarray, radius: int) -> np.ndarray:
        """All (query, item) pairs, as query * items + item, that share a filed value; every pair within the radius is one."""
        found = [np.empty(0, np.int64)]
        for low, high, values, first, items in self._blocks(radius):
            outer = masks(high - low, self.reach(radius)[1])
            step = max(1, CHUNK // len(outer))
            for at in range(0, len(prints), step):
                asked = _block(prints[at : at + step], low, high)[:, None] ^ outer
                place = np.minimum(np.searchsorted(values, asked), len(values) - 1)
                q, mask = np.nonzero(values[place] == asked)
                place = place[q, mask]
                size = first[place + 1] - first[place]
                item = items[np.repeat(first[place] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                found.append(np.unique((at + np.repeat(q, size)) * len(self.prints) + item))
        return np.unique(np.concatenate(found))

    def within(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, item) pairs of fingerprints within the radius."""
        q, item = np.divmod(self.candidates(prints, radius), len(self.prints))
        near = np.bitwise_count(prints[q] ^ self.prints[item]) <= radius
        return q[near], item[near]


def _block(prints: np.ndarray, low: int, high: int) -> np.ndarray:
    return ((prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.uint32)


class BenchmarkIndex:
    def __init__(self, ids: list, texts: list[str | None], threshold: float, shingle_words: int = SHINGLE_WORDS):
        self.threshold = threshold
        words = T.cut_words(pa.array(texts, pa.string()), lower=True)
        h, counts = words.hashes(), words.counts
        groups: dict[int, list[int]] = {}
        for i, n in enumerate(counts.tolist()):
            if n:
                groups.setdefault(n, []).append(i)
        self.lengths: list[Items] = []
        vocabulary: dict[int, list[np.ndarray]] = {}
        for n, members in sorted(groups.items()):
            k = min(shingle_words, n)
            shingles = [T.shingle_hashes(h[words.first[i] : words.first[i + 1]], k) for i in members]
            vocabulary.setdefault(k, []).extend(shingles)
            m = n - k + 1
            need = int(np.ceil(2 * threshold / (1 + threshold) * m - 1e-9))
            prints = H.majority_bits(np.concatenate(shingles), np.arange(len(members) + 1) * m)
            self.lengths.append(Items(n, k, [ids[i] for i in members], as_sets(np.stack(shingles)), prints, max(need, 1), sum(map(len, groups.values()))))
        self.vocabulary = {k: np.unique(np.concatenate(v)) for k, v in vocabulary.items()}
        self.screens = {k: self._screen(v) for k, v in self.vocabulary.items()}

    @staticmethod
    def _screen(values: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << SCREEN_BITS, bool)
        bits[values >> np.uint64(64 - SCREEN_BITS)] = True
        return bits

    def known(self, shingles: np.ndarray, k: int) -> np.ndarray:
        """Which shingles the benchmark has."""
        hit = self.screens[k][shingles >> np.uint64(64 - SCREEN_BITS)]
        at = np.flatnonzero(hit)
        values = self.vocabulary[k]
        place = np.minimum(np.searchsorted(values, shingles[at]), len(values) - 1)
        hit[at] = values[place] == shingles[at]
        return hit

    def search(self, column: pa.Array, radius: int = RADIUS) -> Iterator[tuple[int, object, float, int, int, int]]:
        """(row, item id, best similarity, first word of the best window, item words, matching windows)."""
        words = T.cut_words(column, lower=True)
        h = words.hashes()
        for k in self.vocabulary:
            shingles = T.shingle_hashes(h, k)
            if not len(shingles):
                continue
            known = self.known(shingles, k) & T.within_rows(words.first, k)
            total = np.concatenate(([0], np.cumsum(known)))
            lengths = [x for x in self.lengths if x.k == k]
            # Shingle positions of each row; rows with too few known shingles end here, the others are laid together.
            begin = np.minimum(words.first[:-1], len(shingles))
            end = np.minimum(np.maximum(words.first[1:] - k + 1, words.first[:-1]), len(shingles))
            rows = np.flatnonzero(total[end] - total[begin] >= min(x.need for x in lengths))
            if len(rows):
                at = np.concatenate([np.arange(begin[r], end[r]) for r in rows.tolist()])
                offsets = np.concatenate(([0], np.cumsum(end[rows] - begin[rows])))
                for items in lengths:
                    yield from self._windows(items, rows, offsets, shingles[at], known[at], radius)

    def _windows(self, items: Items, rows: np.ndarray, offsets: np.ndarray, shingles: np.ndarray, known: np.ndarray, radius: int) -> Iterator[tuple]:
        """Matches of one item length in the rows laid together."""
        m = items.n_words - items.k + 1
        if len(shingles) < m:
            return
        total = np.concatenate(([0], np.cumsum(known)))
        own = np.repeat(np.arange(len(rows)), np.diff(offsets))
        place = np.arange(len(shingles) - m + 1)
        starts = np.flatnonzero((total[m:] - total[:-m] >= items.need) & (place + m <= offsets[own[: len(place)] + 1]))
        best: dict[tuple[int, int], list] = {}
        step = max(1, CHUNK // m)
        for part in range(0, len(starts), step):
            at = starts[part : part + step]
            spread = shingles[at[:, None] + np.arange(m)]
            q, item = items.within(H.majority_bits(spread.ravel(), np.arange(len(at) + 1) * m), radius)
            some, which = np.unique(q, return_inverse=True)
            own_sets = as_sets(spread[some])
            score = np.concatenate([np.empty(0), *(similarities(own_sets[which[i : i + step]], items.shingles[item[i : i + step]]) for i in range(0, len(q), step))])
            good = score >= self.threshold
            for start, name, value in zip(at[q[good]].tolist(), item[good].tolist(), score[good].tolist(), strict=True):
                row = int(own[start])
                found = best.setdefault((row, name), [value, start - int(offsets[row]), 0])
                found[2] += 1
                if value > found[0]:
                    found[:2] = [value, start - int(offsets[row])]
        for (row, item), (score, start, windows) in best.items():
            yield int(rows[row]), items.ids[item], score, start, items.n_words, windows


def _parts(benchmark: DataFrame) -> Iterator[tuple[list, list, bool]]:
    """The benchmark's items in parts of bounded size, one on the driver at a time, and whether there is but one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-int(chars) // PART_CHARS))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        yield [r["item_id"] for r in rows], [r["text"] for r in rows], parts == 1


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row for each document row and item that one of its windows matches."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def search_with(index: BenchmarkIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [c.split()[0] for c in SCHEMA.split(",")]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            for batch in itertools.chain.from_iterable(T.slices(b, "text") for b in batches):
                found = list(index.search(batch.column("text"), radius))
                ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                rest = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds) if i]
                yield pa.RecordBatch.from_arrays([ids, *rest], names)

        return run

    found = None
    for ids, items, only in _parts(benchmark):
        some = texts.mapInArrow(search_with(BenchmarkIndex(ids, items, threshold)), SCHEMA)
        some = some if only else checkpointed(some)
        found = some if found is None else found.unionByName(some)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The documents without those that a benchmark item matches; all columns, whatever their names."""

    def clean_with(index: BenchmarkIndex):
        def keep(texts: pa.Array) -> np.ndarray:
            clean = np.ones(len(texts), bool)
            clean[[f[0] for f in index.search(texts, radius)]] = False
            return clean

        return keep

    for ids, items, only in _parts(benchmark):
        docs = kept(docs, clean_with(BenchmarkIndex(ids, items, threshold)))
        docs = docs if only else checkpointed(docs)
    return docs
