"""Substring dedup by repeated-phrase automata (op 7).

Texts are dealt to buckets; a window is `width` consecutive words of one text.

1. *Anchors.* The anchor of a window is the least hash of the phrases of about half its words
   in it, so equal windows have equal anchors and some ten windows in a row share one. Each
   bucket ships its distinct anchors, packed by hash range, and is told which of them other
   buckets have.
2. *Candidates.* Windows under such an anchor are shipped by their 96-bit hashes, each once a
   bucket. A range's reducer puts the buckets that have a window in order and lets each ask
   the one before it (the first asks the second), so a passage that holds a third of the
   corpus is asked of no bucket more than twice.
3. *Passages.* A bucket answers with words: the runs of the windows asked for, as they stand in
   one of its texts.
4. *Automata.* What a bucket got from elsewhere, and what it has twice itself, is compiled into
   Aho-Corasick automata over words, sharded at `AUTOMATON_WORDS` words, and every text of the
   bucket is streamed through each shard. Hits alone decide: a passage from elsewhere is
   recurring where it is found, one of the bucket's own if it is found at two places. Hashes
   only propose; two different windows of equal hash remove nothing.

Ranges are as many as the table's bytes ask for, so a blob holds few windows where buckets are
many; shuffled bytes then grow to some forty an anchor, less than the text itself.

Defined results: a null or blank text has 0 words, 0 removed and the SHA-256 of the empty
string; a text of fewer than `width` words is left whole; repeated rows are repeats of each
other, so both lose the passage; a null id is kept as null; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weblode.llm import text as T

WIDTH = 35
#: Texts of one bucket, in characters; the bucket is what one task holds at once.
BUCKET_CHARS = 4 << 20
#: Characters of texts whose hashes meet in one range.
RANGE_CHARS = 8 << 20
#: Words compiled into one automaton.
AUTOMATON_WORDS = 1 << 19

SPANS = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,stop:int>>"
_ANCHORS = "hash_range int, bucket int, anchors binary"
_TOLD = "bucket int, anchors binary"
_CANDIDATES = "hash_range int, bucket int, keys binary, tails binary"
_ASKED = "bucket int, askers binary, keys binary"
_PASSAGES = "bucket int, passages array<binary>"


@dataclass
class Windows:
    """The windows that lie in one text: first word, 64-bit hash, 32 more bits of another, anchor."""

    starts: np.ndarray
    keys: np.ndarray
    tails: np.ndarray
    anchors: np.ndarray


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    run = 1
    while 2 * run <= width:
        values = np.minimum(values[:-run], values[run:])
        run *= 2
    return np.minimum(values[: len(values) - (width - run)], values[width - run :]) if run < width else values


def windows(words: T.Words, width: int) -> Windows:
    starts = np.flatnonzero(T.within_rows(words.first, width))
    if not len(starts):
        none = np.empty(0, np.uint64)
        return Windows(starts, none, none.astype(np.uint32), none)
    h = words.hashes()
    phrase = width - width // 2
    tails = (T.shingle_hashes(T.mix64(h ^ np.uint64(0x5441494C)), width) >> np.uint64(32)).astype(np.uint32)
    # Least hashes are small ones; mixed again they spread over all ranges.
    anchors = T.mix64(_least(T.shingle_hashes(h, phrase), width // 2 + 1)[starts])
    return Windows(starts, T.shingle_hashes(h, width)[starts], tails[starts], anchors)


def _ranges(values: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """The parts of sorted hashes that lie in each range."""
    here = (values >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    cuts = np.searchsorted(here, np.arange(ranges + 1, dtype=np.uint64))
    return ((r, slice(a, b)) for r, (a, b) in enumerate(itertools.pairwise(cuts.tolist())) if b > a)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _joined(blobs: pa.ChunkedArray, kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), kind)


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of true marks."""
    step = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


# ---- what crosses between buckets ---------------------------------------------------------


def _ship_anchors(width: int, ranges: int):
    def ship(group: pa.Table) -> pa.Table:
        found = np.unique(windows(T.cut_words(group.column("text")), width).anchors)
        bucket = group.column("bucket")[0].as_py()
        return _table([(r, bucket, found[part].tobytes()) for r, part in _ranges(found, ranges)], _ANCHORS)

    return ship


def _meet_anchors(group: pa.Table) -> pa.Table:
    """Tells each bucket which of its anchors others have too; a bucket names an anchor once."""
    parts = [np.frombuffer(x, np.uint64) for x in group.column("anchors").to_pylist()]
    every = np.sort(np.concatenate(parts))
    shared = every[1:][every[1:] == every[:-1]]
    told = ((b, p[_member(p, shared)]) for b, p in zip(group.column("bucket").to_pylist(), parts, strict=True))
    return _table([(b, p.tobytes()) for b, p in told if len(p)], _TOLD)


def _ship_candidates(width: int, ranges: int):
    def ship(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows or not told.num_rows:
            return _table([], _CANDIDATES)
        own = windows(T.cut_words(docs.column("text")), width)
        some = _member(own.anchors, np.sort(_joined(told.column("anchors"))))
        keys, tails = own.keys[some], own.tails[some]
        order = np.lexsort((tails, keys))
        keys, tails = keys[order], tails[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (tails[1:] != tails[:-1])
        keys, tails = keys[new], tails[new]
        bucket = docs.column("bucket")[0].as_py()
        return _table([(r, bucket, keys[part].tobytes(), tails[part].tobytes()) for r, part in _ranges(keys, ranges)], _CANDIDATES)

    return ship


def _pair(group: pa.Table) -> pa.Table:
    """Whom each bucket asks for each window that others have too: the bucket before it, the first one the second."""
    buckets = np.array(group.column("bucket").to_pylist(), np.int64)
    sizes = [len(x) // 8 for x in group.column("keys").to_pylist()]
    keys, tails, own = _joined(group.column("keys")), _joined(group.column("tails"), np.uint32), np.repeat(buckets, sizes)
    order = np.lexsort((own, tails, keys))
    keys, tails, own = keys[order], tails[order], own[order]
    same = np.zeros(len(keys) + 1, bool)  # whether an entry is of the window of the one before it
    same[1:-1] = (keys[1:] == keys[:-1]) & (tails[1:] == tails[:-1])
    asks = np.flatnonzero(same[:-1] | same[1:])
    asked = np.where(same[asks], asks - 1, asks + 1)
    giver, asker = own[asked], own[asks].astype(np.int32)
    order = np.lexsort((asker, giver))
    giver, asker, keys = giver[order], asker[order], keys[asks][order]
    cuts = np.flatnonzero(np.r_[True, giver[1:] != giver[:-1], True]) if len(keys) else np.zeros(1, int)
    return _table([(int(giver[a]), asker[a:b].tobytes(), keys[a:b].tobytes()) for a, b in itertools.pairwise(cuts.tolist())], _ASKED)


def _answer(width: int):
    def answer(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not docs.num_rows or not asked.num_rows:
            return _table([], _PASSAGES)
        words = T.cut_words(docs.column("text"))
        own = windows(words, width)
        keys, first = np.unique(own.keys, return_index=True)
        askers, wanted = _joined(asked.column("askers"), np.int32), _joined(asked.column("keys"))
        place = own.starts[first[np.searchsorted(keys, wanted)]]
        order = np.lexsort((place, askers))
        askers, place = askers[order], place[order]
        cuts = np.flatnonzero(np.r_[True, askers[1:] != askers[:-1], True])
        raw, rows = words.data.tobytes(), []
        for low, high in itertools.pairwise(cuts.tolist()):
            starts = np.unique(place[low:high])
            # Windows of neighbouring texts never touch: the last width - 1 words of a text start none.
            cut = np.flatnonzero(np.diff(starts) != 1)
            begin, end = words.starts[starts[np.r_[0, cut + 1]]], words.ends[starts[np.r_[cut, len(starts) - 1]] + width - 1]
            rows.append((int(askers[low]), [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]))
        return _table(rows, _PASSAGES)

    return answer


# ---- what a bucket finds with its automata ------------------------------------------------


def word_ids(words: T.Words) -> np.ndarray:
    """A number for each word, equal for equal words only: hashes number them, bytes confirm."""
    hashes = words.hashes()
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    size = words.ends - words.starts
    view = np.ndarray((len(words.data) - 7,), "<u8", words.data, strides=(1,))
    sound, twin = size == size[first][ids], words.starts[first][ids]
    at, left, rows = words.starts, np.where(sound, size, 0), np.arange(len(size))
    while len(rows):
        keep = T.KEEP[np.minimum(left, 8)]
        sound[rows] &= (view[at] & keep) == (view[twin] & keep)
        more = left > 8
        rows, at, twin, left = rows[more], at[more] + 8, twin[more] + 8, left[more] - 8
    if not sound.all():
        raw, numbers = words.data.tobytes(), {}
        ids = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)])
    return ids


def _segments(at: np.ndarray, source: np.ndarray, width: int) -> set[tuple[int, int]]:
    """The parts (start, stop) of the source that runs of windows at `at` run along."""
    if not len(at):
        return set()
    cut = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(source) != 1)])
    last = np.r_[cut[1:], len(at)] - 1
    return set(zip(source[cut].tolist(), (source[last] + width).tolist(), strict=True))


def _automata(passages: dict[tuple, bool], ids: np.ndarray) -> Iterator[tuple[ahocorasick.Automaton, np.ndarray, list]]:
    """Automata over the passages in shards of bounded size, one alive at a time, with the symbol of each word id in it."""
    shard, held = [], 0
    for n, (span, foreign) in enumerate(passages.items(), 1):
        shard.append((*span, foreign))
        held += span[1] - span[0]
        if held >= AUTOMATON_WORDS or n == len(passages):
            used = np.unique(np.concatenate([ids[a:b] for a, b, _ in shard]))
            symbols = np.zeros(int(ids.max()) + 1, np.uint32)
            symbols[used] = np.arange(1, len(used) + 1)
            symbols[symbols >= 0xD800] += 0x800  # no surrogates
            automaton, kept = ahocorasick.Automaton(), []
            for a, b, foreign in shard:
                phrase = symbols[ids[a:b]].tobytes().decode("utf-32-le")
                known = automaton.get(phrase, None)
                if known is None:
                    automaton.add_word(phrase, len(kept))
                    kept.append([b - a, foreign])
                else:
                    kept[known][1] |= foreign
            automaton.make_automaton()
            yield automaton, symbols, kept
            shard, held = [], 0


def locate(words: T.Words, n_docs: int, width: int) -> np.ndarray:
    """Marks the documents' words that recurring windows cover; rows after the documents are passages from elsewhere."""
    n = int(words.first[n_docs])
    marks = np.zeros(n, bool)
    own = windows(words, width)
    inner = int(np.searchsorted(own.starts, n))
    if not inner:
        return marks
    passages: dict[tuple, bool] = {}  # span of words -> whether it came from elsewhere
    foreign, first = np.unique(own.keys[inner:], return_index=True)
    here = _member(own.keys[:inner], foreign)
    source = own.starts[inner:][first[np.searchsorted(foreign, own.keys[:inner][here])]] if len(foreign) else np.empty(0, np.int64)
    passages |= dict.fromkeys(sorted(_segments(own.starts[:inner][here], source, width)), True)
    _, first, which, times = np.unique(own.keys[:inner], return_index=True, return_inverse=True, return_counts=True)
    again = (times[which] > 1) & ~here
    source = own.starts[first[which[again]]]
    passages |= dict.fromkeys(sorted(_segments(own.starts[:inner][again], source, width)), False)
    if not passages:
        return marks
    ids = word_ids(words)
    # One symbol between texts that no passage has.
    gaps = np.arange(n) + np.repeat(np.arange(n_docs), words.counts[:n_docs])
    step = np.zeros(n + n_docs + 1, np.int64)
    for automaton, symbols, kept in _automata(passages, ids):
        stream = np.zeros(n + n_docs, np.uint32)
        stream[gaps] = symbols[ids[:n]]
        hits = [(end, number) for end, number in automaton.iter(stream.tobytes().decode("utf-32-le"))]
        if hits:
            end, number = np.array(hits, np.int64).T
            size, sure = np.array([k[0] for k in kept]), np.array([k[1] for k in kept])
            good = sure[number] | (np.bincount(number, minlength=len(kept)) > 1)[number]
            stop = end[good] + 1
            step += np.bincount(stop - size[number[good]], minlength=len(step)) - np.bincount(stop, minlength=len(step))
    return (np.cumsum(step) > 0)[gaps]


def _strip(width: int):
    def strip(docs: pa.Table, told: pa.Table) -> pa.Table:
        kinds = _types()
        if not docs.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kinds.items()})
        passages = [p for some in told.column("passages").to_pylist() for p in some]
        # Passages are cut at white space, so they are text like the texts they came from.
        column = pa.chunked_array([*docs.column("text").cast(pa.large_string()).chunks, pa.array(passages, pa.large_binary()).cast(pa.large_string())])
        words, n = T.cut_words(column), docs.num_rows
        gone = locate(words, n, width)
        first = words.first[: n + 1]
        removed = T.row_sums(gone, first)
        digests, spans = [], []
        raw, rows = words.data.tobytes(), words.rows.tolist()
        for i, (a, b) in enumerate(itertools.pairwise(first.tolist())):
            kept = raw[rows[i] : rows[i + 1]].split()
            found = []
            if removed[i]:
                mask = gone[a:b]
                kept = list(itertools.compress(kept, (~mask).tolist()))
                found = [{"start": s, "stop": e} for s, e in zip(*(x.tolist() for x in _runs(mask)), strict=True)]
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            spans.append(found)
        return pa.table(
            [docs.column("doc_id").cast(pa.int64()), pa.array(words.counts[:n], pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, kinds["spans"])],
            list(kinds),
        )

    return strip


def _types() -> dict[str, pa.DataType]:
    return {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))}


def repeated_passages(docs: DataFrame, width: int = WIDTH, buckets: int | None = None, ranges: int | None = None) -> DataFrame:
    """Per document: its words, the words removed, the removed spans (word offsets) and the digest of what is kept."""
    if width < 2:
        raise ValueError("a window has two words at least")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = 0
    if buckets is None or ranges is None:
        chars = int(texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0)
    buckets = buckets or max(16, -(-chars // BUCKET_CHARS))
    ranges = ranges or max(16, -(-chars // RANGE_CHARS))
    # The row's place in its split goes into the hash, so that rows equal in everything are not one bucket's.
    dealt = texts.withColumn("bucket", F.pmod(F.xxhash64("text", "doc_id", F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    by_bucket = dealt.groupBy("bucket")
    told = by_bucket.applyInArrow(_ship_anchors(width, ranges), _ANCHORS).groupBy("hash_range").applyInArrow(_meet_anchors, _TOLD)
    candidates = by_bucket.cogroup(told.groupBy("bucket")).applyInArrow(_ship_candidates(width, ranges), _CANDIDATES)
    asked = candidates.groupBy("hash_range").applyInArrow(_pair, _ASKED)
    passages = by_bucket.cogroup(asked.groupBy("bucket")).applyInArrow(_answer(width), _PASSAGES)
    return by_bucket.cogroup(passages.groupBy("bucket")).applyInArrow(_strip(width), SPANS)
