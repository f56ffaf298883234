"""Toxicity by maximum-scoring segment search (op 3).

*Model.* From a bounded sample of labelled documents each word, and each stem of a few
bytes, gets a log-odds score with a Dirichlet prior: half a count plus the term's share in
both classes together times `prior_words`. Every term keeps its score, weighted by how likely
its z value is to come from a term that differs at all; a word's own score leans on its
stem's as far as it is not sure itself. The scores' drift is set so that exp(score) averages 1
over the words of the clean sample, which makes clean text drift down. Scores are integers
(thousandths of a nat), so their sums are exact.

*Search.* One linear pass over a text's prefix sums finds every maximal scoring segment
(Ruzzo and Tompa); those above the significance threshold are the toxic passages.

*Calibration.* Segment scores of clean text follow an extreme-value law: lambda is the positive
root of E[exp(lambda s)] = 1 over the clean word scores, K is fitted on the clean sample. A
segment of score s in n words has the expected count E = K n exp(-lambda s); the passages of
a document add up to one evidence value, which a logistic curve fitted on the sample turns
into a probability.

Defined results: a null, blank or very short text has no segment and scores as its evidence of
zero says; very long texts are scanned whole; repeated rows score alike; null ids are kept;
an empty table gives an empty result; without labels every score is the prior 0.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weblode.llm import text as T
from weblode.llm.spark_io import kept

#: Labelled documents that the model is fitted on: at most so many of each label, and so many characters of
#: them, by the order of a hash of the id.
SAMPLE_TOXIC = 1000
SAMPLE_CLEAN = 2000
SAMPLE_CHARS = 64 << 20
THRESHOLD = 0.3
UNIT = 1000.0
#: Least drift of a word, in nats.
DRIFT = 0.1
#: Spread of z among terms that differ between the classes.
SPREAD = 5.0
STEM_BYTES = 4
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
SEGMENTS = "array<struct<start:int,stop:int,score:double,expected:double>>"
SCHEMA = f"doc_id long, score double, evidence double, passages {SEGMENTS}"


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the sample's words and stems
    scores: np.ndarray  # int64, thousandths of a nat
    common: int  # the score of a word whose stem is new too
    lam: float
    k: float
    slope: float
    bias: float
    significant: float = 0.01  # expected count below which a segment is a passage

    def word_scores(self, whole: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """Score of each word: its own, else its stem's, else the common word's."""
        out = np.full(len(whole), self.common, np.int64)
        if len(self.words):
            for term in (stem, whole):
                at = np.minimum(np.searchsorted(self.words, term), len(self.words) - 1)
                hit = self.words[at] == term
                out[hit] = self.scores[at[hit]]
        return out

    def expected(self, score: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Expected number of segments of at least this score in so many clean words."""
        return self.k * np.maximum(n_words, 1) * np.exp(-self.lam * score)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * evidence + self.bias, -60, 60)))


def segments(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal scoring segments (start, stop, score) of one text, in linear time.

    Runs of equal sign are summed first; each candidate remembers the prefix sums at its
    ends and the nearest earlier one that starts below it, and merges leftwards while that one
    ends lower. Going by what candidates remember, none is passed over twice.
    """
    sign = scores > 0
    if not sign.any():
        return []
    edge = np.flatnonzero(np.diff(sign.astype(np.int8))) + 1
    starts, stops = np.r_[0, edge], np.r_[edge, len(scores)]
    prefix = np.concatenate(([0], np.cumsum(scores)))
    found: list[tuple[int, int, int, int, int]] = []  # start, stop, prefix before, prefix after, nearest that starts lower
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        if not sign[a]:
            continue
        left, right, j = int(prefix[a]), int(prefix[b]), len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((a, b, left, right, j))
                break
            a, _, left, _, lower = found[j]
            del found[j:]
            j = lower
    return [(a, b, right - left) for a, b, left, right, _ in found]


def best_segments(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The score of each row's best segment (0 if none), all rows in one pass.

    Prefix sums minus their running minimum; a falling offset per row, larger than any
    sum, restarts the minimum at each row.
    """
    n = len(first) - 1
    out = np.zeros(n, np.int64)
    if not len(scores):
        return out
    reach = int(np.abs(scores).sum()) + 1
    rows = np.repeat(np.arange(n), np.diff(first))
    after = np.cumsum(scores)
    before = after - scores
    low = np.minimum.accumulate(before - rows * reach) + rows * reach
    full = np.flatnonzero(np.diff(first))
    out[full] = np.maximum(np.maximum.reduceat(after - low, first[full]), 0)
    return out


def evidence_of(model: Model, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """Summed -log expected count of each row's significant passages, and the passages.

    A row without one has the value of its best segment, at least 0; one without any segment has 0.
    """
    best = best_segments(scores, first)
    words = np.diff(first)
    value = np.where(best > 0, np.maximum(-np.log(np.maximum(model.expected(best / UNIT, words), 1e-300)), 0.0), 0.0)
    passages: list[list[dict]] = [[] for _ in range(len(words))]
    for i in np.flatnonzero((best > 0) & (value > -np.log(model.significant))):
        a, b = int(first[i]), int(first[i + 1])
        total = 0.0
        for start, stop, score in segments(scores[a:b]):
            e = float(model.expected(np.array(score / UNIT), np.array(b - a)))
            if e < model.significant:
                passages[i].append({"start": start, "stop": stop, "score": score / UNIT, "expected": e})
                total += -np.log(max(e, 1e-300))
        value[i] = max(value[i], total)
    return value, passages


def held_out(doc_id: Column) -> Column:
    """The ids that no model here learns from: CRC-32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, chars: int = SAMPLE_CHARS
) -> tuple[list[str], np.ndarray, float | None]:
    """Texts and labels of the bounded training sample, without held-out ids, and the toxic share of all labels it stands for.

    An id labelled both ways is toxic; of several texts of an id the least is taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg("toxic")).first()[0]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(clean))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # A few thousand rows at most; the longest sample texts at the end of the order are left out if there are too many characters.
    so_far = F.sum(F.length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= chars).select("doc_id", "toxic", "text").toArrow()
    rows = rows.take(pa.array(np.argsort(rows.column("doc_id").to_numpy(), kind="stable")))
    return rows.column("text").to_pylist(), rows.column("toxic").to_numpy(), share


def terms(words: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its stem: its first STEM_BYTES bytes, salted so that no stem is a word."""
    view = np.ndarray((len(words.data) - 7,), "<u8", words.data, strides=(1,))
    bits = np.uint64((1 << (8 * STEM_BYTES)) - 1)
    long = words.ends - words.starts > STEM_BYTES
    stem = T.mix64((view[words.starts] & bits) ^ np.uint64(0x5354454D00000000))
    whole = words.hashes()
    return whole, np.where(long, stem, whole)


def plain_words(column: pa.Array) -> T.Words:
    """Words in lower case without the punctuation at their edges; a word of punctuation alone stays."""
    words = T.cut_words(column, lower=True)
    starts, ends = words.starts.copy(), words.ends.copy()
    for edge, step, inner in ((starts, 1, 0), (ends, -1, -1)):
        some = np.arange(len(starts))
        while len(some := some[_PUNCTUATION[words.data[edge[some] + inner]] & (ends[some] - starts[some] > 1)]):
            edge[some] += step
    return T.Words(words.data, words.rows, starts, ends, words.first)


def _differing(z: np.ndarray) -> np.ndarray:
    """How likely each z value comes from a term that differs between the classes: two normal laws, their shares by expectation steps."""
    null, slab = np.exp(-0.5 * np.minimum(z * z, 1400)), np.exp(-0.5 * np.minimum(z * z / (1 + SPREAD**2), 1400)) / np.sqrt(1 + SPREAD**2)
    share = 0.05
    for _ in range(30):
        sure = share * slab / np.maximum(share * slab + (1 - share) * null, 1e-300)
        share = min(max(float(sure.mean()), 1e-4), 0.5)
    return sure


def fit(texts: list[str], toxic: np.ndarray, share: float | None = None, prior_words: float = 100.0) -> Model:
    """The model of a sample; `share` is the toxic share that the calibration is to stand for, else the sample's own.

    A term is counted once for each pair of neighbours it stands between, so that copies of
    a document, or of a passage, weigh once.
    """
    model = Model(np.empty(0, np.uint64), np.empty(0, np.int64), -int(DRIFT * UNIT), 1.0, 1.0, 0.0, -60.0)
    if not len(texts) or toxic.min() == toxic.max():
        return model
    words = plain_words(pa.array(texts))
    whole, stem = terms(words)
    label = np.repeat(toxic == 1, words.counts)
    around = np.zeros(len(whole), np.uint64)
    around[1:] += T.mix64(whole[:-1])
    around[:-1] += T.mix64(whole[1:] ^ np.uint64(1))
    _, once = np.unique(T.mix64(whole) * np.uint64(3) + around, return_index=True)

    def scored(term: np.ndarray) -> tuple[np.ndarray, ...]:
        """The distinct terms, where each first stands, their log-odds, and how sure these are."""
        distinct, first, ids = np.unique(term[once], return_index=True, return_inverse=True)
        bad = np.bincount(ids[label[once]], minlength=len(distinct)).astype(float)
        good = np.bincount(ids[~label[once]], minlength=len(distinct)).astype(float)
        prior = 0.5 + (bad + good) / (bad.sum() + good.sum()) * prior_words
        total = prior.sum()
        odds = lambda y, n: np.log((y + prior) / (n + total - y - prior))
        delta = odds(bad, bad.sum()) - odds(good, good.sum())
        return distinct, once[first], delta, _differing(delta / np.sqrt(1 / (bad + prior) + 1 / (good + prior)))

    stems, _, delta, sure = scored(stem)
    stem_scores = sure * delta
    wholes, first, delta, sure = scored(whole)
    whole_scores = sure * delta + (1 - sure) * stem_scores[np.searchsorted(stems, stem[first])]
    order = np.argsort(np.r_[stems, wholes], kind="stable")
    values = np.r_[stems, wholes][order]
    # A word no longer than its stem is the same term twice; its score as a word is the later one.
    last = np.r_[values[1:] != values[:-1], True]
    model.words, scores = values[last], np.r_[stem_scores, whole_scores][order][last]
    clean = scores[np.searchsorted(model.words, whole[~label])]
    drift = max(DRIFT, float(np.log(np.exp(clean).mean()))) if len(clean) else DRIFT
    model.scores, model.common = np.rint((scores - drift) * UNIT).astype(np.int64), -int(np.rint(drift * UNIT))
    _calibrate(model, model.word_scores(whole, stem), words.first, toxic, share)
    return model


def _calibrate(model: Model, scores: np.ndarray, first: np.ndarray, toxic: np.ndarray, share: float | None = None) -> None:
    """Lambda and K of the extreme-value law on the clean sample, then the logistic curve on all of it, each label by its true share."""
    clean_word = np.repeat(toxic == 0, np.diff(first))
    values, counts = np.unique(scores[clean_word] / UNIT, return_counts=True)
    part = counts / max(counts.sum(), 1)
    low, high = 1e-6, 50.0
    if (values > 0).any():
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if (part * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (low, mid)
        model.lam = low
    else:
        model.lam = 1.0
    best = best_segments(scores, first) / UNIT
    words = np.maximum(np.diff(first), 1)
    clean = toxic == 0
    # P(best < s) = exp(-K n exp(-lambda s)): the likelihood in K is greatest at rows / sum of n exp(-lambda s).
    model.k = float(clean.sum() / max((words[clean] * np.exp(-model.lam * best[clean])).sum(), 1e-300))
    x, _ = evidence_of(model, scores, first)
    y = toxic.astype(float)
    scale = max(float(np.std(x)), 1e-9)
    u = x / scale
    own = y.mean()
    share = own if share is None or not 0 < share < 1 else share
    weight = np.where(toxic == 1, share / own, (1 - share) / (1 - own))
    w, b = 1.0, 0.0
    for _ in range(100):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(w * u + b, -60, 60)))
        r, miss = weight * np.maximum(p * (1 - p), 1e-9), weight * (p - y)
        g = np.array([(miss * u).sum() + 1e-2 * w, miss.sum()])
        h = np.array([[(r * u * u).sum() + 1e-2, (r * u).sum()], [(r * u).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        w, b = w - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.bias = w / scale, b


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Every document's score, evidence and significant passages (word offsets). The model has the sample's terms: a few MB at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in itertools.chain.from_iterable(T.slices(b, "text") for b in batches):
            words = plain_words(batch.column("text"))
            x, passages = evidence_of(model, model.word_scores(*terms(words)), words.first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.probability(x)), pa.array(x), pa.array(passages, kind)], ["doc_id", "score", "evidence", "passages"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold; all columns, whatever their names."""

    def keep(texts: pa.Array) -> np.ndarray:
        words = plain_words(texts)
        x, _ = evidence_of(model, model.word_scores(*terms(words)), words.first)
        return model.probability(x) < threshold

    return kept(docs, keep)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model fitted on the labelled, not held-out ones among them."""
    return score_texts(docs, fit(*sample(docs, labels)))
