"""Quality rules and line sequence labelling (op 5).

Base rules count words, symbols, repeated lines and repeated phrases of the whole text. The
method's verdict comes from a linear-chain conditional random field over the lines that hold
a word: each line shows some binary cues, Viterbi decoding marks every line as content or
boilerplate, and the share of words on content lines decides.

Training: the chain's labels come from document labels in two steps. A logistic regression of
the cues on the document's quality first tells which lines of poor documents look poor; those
are boilerplate, all others content. The chain is then fitted by gradient ascent on its
conditional likelihood (forward-backward). The sample is bounded and leaves out held-out ids.

Defined results: a null or blank text has no words, fails the base rules and is not kept; very
long texts are labelled whole; repeated rows get the same verdict; null ids are kept; an empty
table gives an empty result; without labels every line is content.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weblode.llm import text as T

PHRASE_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_CONTENT_SHARE = 0.5
#: Training documents of each label, and characters of them all.
SAMPLE_EACH = 1500
SAMPLE_CHARS = 64 << 20
#: Lines that training takes as one sequence; a longer document is several.
PIECE_LINES = 200
CUES = (
    "bias", "some symbols", "many symbols", "mostly symbols", "bars", "upper case", "shouting", "stuttering",
    "repeats a line", "one or two words", "few words", "long line", "ends a sentence", "starts upper", "long words", "digits",
)
_IS = {name: np.zeros(256, bool) for name in ("symbol", "upper", "lower", "bang", "digit", "stop")}
_IS["symbol"][list(b"#*$%&|<>")] = True
_IS["upper"][65:91] = True
_IS["lower"][97:123] = True
_IS["bang"][ord("!")] = True
_IS["digit"][48:58] = True
_IS["stop"][list(b".!?:;")] = True
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, content_words long, n_lines int, content_lines int, kept boolean"
)


@dataclass
class Chain:
    """Weights for content against boilerplate: one per cue, and one per (previous, next) label pair."""

    cues: np.ndarray
    moves: np.ndarray  # 2 x 2; label 1 is content


@dataclass
class Lines:
    """Lines with a word: word offsets (n + 1), line offsets of the rows, and the cues of each line."""

    first: np.ndarray
    of_row: np.ndarray
    cues: np.ndarray


def _span_sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def read_lines(words: T.Words, hashes: np.ndarray, repeated: np.ndarray) -> Lines:
    """`repeated`: for each line with a word whether it equals an earlier line of its text."""
    data = words.data[:-8]
    row = words.row_of
    breaks = np.concatenate(([0], np.cumsum(data == 10)))[words.starts]
    new = np.ones(len(row), bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    first = np.r_[begin, len(row)]
    of_row = np.searchsorted(begin, words.first)
    a, b = words.starts[begin], words.ends[first[1:] - 1]
    n = np.diff(first)
    count = {name: _span_sums(mask[data], a, b) for name, mask in _IS.items() if name != "stop"}
    letters = np.maximum(count["upper"] + count["lower"], 1)
    same = np.zeros(len(row), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & ~new[1:]
    bars = _span_sums(data == ord("|"), a, b)
    size = np.maximum(b - a, 1)
    cues = np.stack(
        [
            np.ones(len(n), bool),
            count["symbol"] > 0,
            count["symbol"] * 4 > n,
            count["symbol"] > n,
            bars >= 2,
            count["upper"] * 2 > letters,
            count["bang"] * 2 > n,
            T.row_sums(same, first) * 3 > n,
            repeated,
            n <= 2,
            n <= 5,
            n > 30,
            _IS["stop"][data[b - 1]] if len(b) else np.empty(0, bool),
            _IS["upper"][data[a]] if len(a) else np.empty(0, bool),
            size > 12 * n,
            count["digit"] * 5 > size,
        ],
        axis=1,
    )
    return Lines(first, of_row, cues.astype(np.float64))


def _ranks(of_row: np.ndarray) -> list[np.ndarray]:
    """Line positions in lockstep: element t holds the t-th line of every row that has one, long rows first."""
    size = np.diff(of_row)
    order = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
    start = of_row[:-1][order]
    return [start[:m] + t for t, m in enumerate(alive)]


def viterbi(chain: Chain, lines: Lines) -> np.ndarray:
    """The likeliest labels (True: content) of all lines; a tie falls to content."""
    score = lines.cues @ chain.cues
    steps = _ranks(lines.of_row)
    best = np.zeros((len(score), 2))
    came = np.zeros((len(score), 2), bool)
    for t, at in enumerate(steps):
        if t:
            before = best[at - 1]
            for to in (0, 1):
                stay, swap = before[:, 1] + chain.moves[1, to], before[:, 0] + chain.moves[0, to]
                came[at, to] = stay >= swap
                best[at, to] = np.maximum(stay, swap)
        best[at, 1] += score[at]
    label = np.zeros(len(score), bool)
    for t in range(len(steps) - 1, -1, -1):
        at = steps[t]
        last = at if t + 1 == len(steps) else at[len(steps[t + 1]) :]
        label[last] = best[last, 1] >= best[last, 0]
        more = at[: len(at) - len(last)]
        label[more] = came[more + 1, label[more + 1].astype(int)]
    return label


def _marginals(chain: Chain, lines: Lines, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each line, and the expected label-pair counts, by forward-backward."""
    score = np.stack([np.zeros(len(lines.cues)), lines.cues @ chain.cues], axis=1)
    fore = np.zeros_like(score)
    for t, at in enumerate(steps):
        fore[at] = score[at] if not t else score[at] + np.logaddexp(fore[at - 1, :1] + chain.moves[0], fore[at - 1, 1:] + chain.moves[1])
    back = np.zeros_like(score)
    pairs = np.zeros((2, 2))
    for t in range(len(steps) - 2, -1, -1):
        at = steps[t + 1] - 1
        ahead = score[at + 1] + back[at + 1]
        joint = fore[at][:, :, None] + chain.moves[None] + ahead[:, None, :]
        back[at] = np.logaddexp(chain.moves[:, 0] + ahead[:, :1], chain.moves[:, 1] + ahead[:, 1:])
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    both = fore + back
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60))), pairs


def fit(lines: Lines, good: np.ndarray, rounds: int = 120, ridge: float = 1.0) -> Chain:
    """The chain of a sample; `good` holds the quality of each row."""
    width = len(CUES)
    if not len(lines.cues) or good.min() == good.max():
        return Chain(np.r_[1.0, np.zeros(width - 1)], np.zeros((2, 2)))
    row = np.repeat(np.arange(len(good)), np.diff(lines.of_row))
    y, w = good[row].astype(float), np.zeros(width)
    for _ in range(25):  # logistic regression by Newton steps
        p = 1 / (1 + np.exp(-np.clip(lines.cues @ w, -30, 30)))
        slope = lines.cues.T @ (p - y) + ridge * w
        bend = (lines.cues * (p * (1 - p))[:, None]).T @ lines.cues + ridge * np.eye(width)
        w -= np.linalg.solve(bend, slope)
    label = (good[row] == 1) | (lines.cues @ w >= 0)
    steps = _ranks(lines.of_row)
    inner = np.ones(len(label), bool)
    inner[lines.of_row[:-1][np.diff(lines.of_row) > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[at - 1].astype(int), label[at].astype(int)), 1)
    chain, n = Chain(w.copy(), np.zeros((2, 2))), max(len(label), 1)
    velocity_w, velocity_m, rate = np.zeros(width), np.zeros((2, 2)), 2.0
    for _ in range(rounds):  # gradient ascent with momentum
        p, pairs = _marginals(chain, lines, steps)
        up_w = (lines.cues.T @ (label - p) - ridge * chain.cues) / n
        up_m = (seen - pairs - ridge * chain.moves) / n
        velocity_w, velocity_m = 0.9 * velocity_w + rate * up_w, 0.9 * velocity_m + rate * up_m
        chain = Chain(chain.cues + velocity_w, chain.moves + velocity_m)
    return chain


def repeats(words: T.Words) -> np.ndarray:
    """For each line with a word whether it equals an earlier line of its text."""
    raw, rows = words.data.tobytes(), words.rows.tolist()
    out: list[bool] = []
    for a, b in itertools.pairwise(rows):
        seen: set[bytes] = set()
        for line in raw[a:b].split(b"\n"):
            if not line.isspace() and line:
                out.append(line in seen)
                seen.add(line)
    return np.array(out, bool)


def repeat_words(words: T.Words, hashes: np.ndarray, k: int = PHRASE_WORDS) -> np.ndarray:
    """Per row the words covered by k-word phrases that occur twice or more in the row."""
    starts = np.flatnonzero(T.within_rows(words.first, k))
    if not len(starts):
        return np.zeros(len(words.counts), np.int64)
    phrase = T.shingle_hashes(hashes, k)[starts] ^ T.mix64(words.row_of[starts].astype(np.uint64) + np.uint64(1))
    order = np.argsort(phrase)
    ranked = phrase[order]
    twin = np.zeros(len(starts), bool)
    same = ranked[1:] == ranked[:-1]
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    return T.row_sums(T.covered(starts[twin], k, len(hashes)), words.first)


def sample(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and quality labels of the bounded training sample, without held-out ids.

    An id labelled both ways is poor; of several texts of an id the least is taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("quality = 1").orderBy(*order).limit(each).unionByName(known.where("quality = 0").orderBy(*order).limit(each))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    so_far = F.sum(F.length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= chars).select("doc_id", "quality", "text").toArrow()
    rows = rows.take(pa.array(np.argsort(rows.column("doc_id").to_numpy(), kind="stable")))
    return rows.column("text").to_pylist(), rows.column("quality").to_numpy()


def fit_texts(texts: list[str], good: np.ndarray) -> Chain:
    words = T.cut_words(pa.array(texts, pa.string()))
    return fit(*in_pieces(read_lines(words, words.hashes(), repeats(words)), np.asarray(good)))


def in_pieces(lines: Lines, good: np.ndarray, most: int = PIECE_LINES) -> tuple[Lines, np.ndarray]:
    """All lines, those of long rows as rows of at most `most` lines, each with its row's label."""
    size = np.diff(lines.of_row)
    pieces = np.maximum(-(-size // most), 1)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(lines.of_row[:-1], pieces) + nth * most
    return replace(lines, of_row=np.append(starts, lines.of_row[-1])), np.repeat(good, pieces)


def judge(docs: DataFrame, chain: Chain, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """Base counts, labelled lines and verdict of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(T.slices(b, "text") for b in batches):
            words = T.cut_words(batch.column("text"))
            hashes, again = words.hashes(), repeats(words)
            lines = read_lines(words, hashes, again)
            content = viterbi(chain, lines)
            data = words.data[:-8]
            n = words.counts
            chars = T.row_sums(_span_sums((data & 0xC0) != 0x80, words.starts, words.ends), words.first)
            symbols = _span_sums(_IS["symbol"][data], words.rows[:-1], words.rows[1:])
            phrases = repeat_words(words, hashes)
            failed = (n < MIN_WORDS) | (100 * phrases > MAX_REPEAT_PERCENT * n)
            on_content = T.row_sums(np.where(content, np.diff(lines.first), 0), lines.of_row)
            columns = [
                n, chars, symbols, T.row_sums(again, lines.of_row), phrases, failed, on_content,
                np.diff(lines.of_row).astype(np.int32), T.row_sums(content, lines.of_row).astype(np.int32), ~failed & (on_content >= min_share * n),
            ]
            names = [c.split()[0] for c in SCHEMA.split(",")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdicts on all documents by a chain fitted on the labelled, not held-out ones among them."""
    return judge(docs, fit_texts(*sample(docs, labels)))
