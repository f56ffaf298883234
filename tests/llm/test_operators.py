"""Each operator against a brute-force version on small tables, and its edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weblode.llm import (
    decontamination, hamming as H, license_scan, mixing, near_dedup, quality, range_coder as R, sharding, substring_dedup, text as T, token_output, toxicity, url_filters,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bits string"


def table(spark, texts, ids=None):
    """Documents with an extra column whose name operators use themselves."""
    rows = [(i if ids is None else ids[i], t, "en", f"src{i % 3}" if i % 4 else None, len(t or ""), "extra") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def made_texts(seed=5):
    """Short and long texts that share passages, copies, near copies, and edge cases."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(60), say(45)]
    texts = [say(rng.randint(1, 120)) for _ in range(20)]
    texts += [f"{say(20)}\n{shared[i % 2]} {say(15)}" for i in range(6)]
    texts += [texts[0], texts[0], texts[3] + " tail", " ".join(["again"] * 80), " ".join(["again"] * 60)]
    return texts + [None, "", " \n\t ", "one", "a b", "x" * 5000, say(5000), "é ü ß", "THE and THE\nand"]


@pytest.fixture(scope="module")
def texts():
    return made_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, texts).cache()


# ---- text ------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b'.A", max_size=60)), max_size=12), st.integers(1, 7))
def test_words_and_shingles(texts, k):
    words = T.cut_words(pa.array(texts, pa.string()))
    expected = [WORD.findall(t or "") for t in texts]
    got = [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)]
    assert got == [w for row in expected for w in row]
    assert words.counts.tolist() == [len(r) for r in expected]
    inside = T.within_rows(words.first, k)
    starts = np.flatnonzero(inside)
    tuples = [tuple(got[s : s + k]) for s in starts]
    assert tuples == [tuple(r[i : i + k]) for r in expected for i in range(len(r) - k + 1)]
    hashes = T.shingle_hashes(words.hashes(), k)[starts] if len(starts) else []
    assert len(set(map(int, hashes))) == len(set(tuples))


# ---- 1 sharding ------------------------------------------------------------------------


def test_sharding(spark, docs, texts):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_sharding_follows_weights_and_confines_movement(spark):
    keys = spark.range(4000).withColumnRenamed("id", "key")
    even = sharding.uniform_topology()
    heavy = sharding.uniform_topology(weights={0: 3.0})
    both = sharding.assign(sharding.assign(keys, "key", even, "a"), "key", heavy, "b").toPandas()
    assert abs((both.b == 0).mean() - 0.3) < 0.04
    assert (both.b[both.a != both.b] <= 3).all()  # only into the region whose weight rose
    grown = sharding.assign(keys, "key", even.grown().grown(), "c").toPandas()
    moved = grown.c.to_numpy() != both.a.to_numpy()
    assert set(grown.c[moved]) == {8, 9}


def test_sharding_edges(spark):
    same = table(spark, ["x", "x", None, "y"], [7, 7, None, None])
    rows = sharding.shard_documents(same).collect()
    assert len(rows) == 4
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_documents(same.limit(0)).count() == 0


# ---- 2 decontamination -----------------------------------------------------------------


def brute_matches(texts, items):
    found = set()
    low = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    for d, text in enumerate(texts):
        w = low(text)
        for item, other in enumerate(items):
            v = low(other)
            k = min(5, len(v))
            want = Counter(tuple(v[i : i + k]) for i in range(len(v) - k + 1)) if v else Counter()
            for s in range(len(w) - len(v) + 1) if v else ():
                have = Counter(tuple(w[s + i : s + i + k]) for i in range(len(v) - k + 1))
                common = (have & want).total()
                if common >= 0.8 * (have.total() + want.total() - common) - 1e-12:
                    found.add((d, item))
    return found


def test_decontamination(spark, texts):
    rng = random.Random(3)
    base = WORD.findall(texts[-3])
    items = [" ".join(base[100:140]), " ".join(base[300:360]).upper(), "not anywhere at all here", "a b", "one", None, " ", " ".join(base[700:715])]
    changed = base[300:360]
    changed[1] = "new"
    more = [*texts, "lead " + " ".join(changed) + " end", " ".join(rng.sample(base[100:140], 40))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(table(spark, more), bench).collect()}
    assert got == brute_matches(more, items) and len(got) >= 5
    kept = decontamination.decontaminate(table(spark, more), bench)
    assert kept.columns == table(spark, more).columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(more))) - {d for d, _ in got}


def test_decontamination_in_parts(spark, texts, monkeypatch):
    bench = spark.createDataFrame([(0, " ".join(WORD.findall(texts[-3])[:30])), (1, "one"), (2, "a b")], "item_id long, text string")
    whole = sorted(tuple(r) for r in decontamination.matches(table(spark, texts), bench).collect())
    monkeypatch.setattr(decontamination, "PART_CHARS", 20)
    assert sorted(tuple(r) for r in decontamination.matches(table(spark, texts), bench).collect()) == whole
    assert decontamination.matches(table(spark, texts), bench.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30), st.integers(0, 24))
def test_multi_index_finds_all_within_the_radius(prints, radius):
    x = np.array(prints, np.uint64)
    x = np.concatenate([x, x ^ np.uint64(0b1011)])
    items = decontamination.Items(5, 5, list(range(len(x))), [], x, 1)
    got = set(zip(*(v.tolist() for v in items.within(x, radius)), strict=True))
    assert got == {(a, b) for a in range(len(x)) for b in range(len(x)) if (int(x[a]) ^ int(x[b])).bit_count() <= radius}


# ---- 3 toxicity ------------------------------------------------------------------------


def all_segments(scores):
    """Maximal scoring segments by the recursive definition: the best one, then left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if not best or best[0] <= 0:
        return []
    _, _, _, a, b = best
    left, right = all_segments(scores[:a]), all_segments(scores[b:])
    return left + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in right]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-9, 9).filter(bool), max_size=14))
def test_maximal_segments(scores):
    scores = [s * 1000 + i for i, s in enumerate(scores)]  # no ties
    assert toxicity.segments(np.array(scores, np.int64)) == all_segments(scores)


def test_best_segments_by_row():
    rng = np.random.default_rng(0)
    rows = [rng.integers(-5, 5, n) for n in (0, 1, 7, 0, 30, 3)]
    first = np.cumsum([0, *map(len, rows)])
    expected = [max([0, *(int(r[a:b].sum()) for a in range(len(r)) for b in range(a + 1, len(r) + 1))]) for r in rows]
    assert toxicity.best_segments(np.concatenate(rows).astype(np.int64), first).tolist() == expected


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).toPandas()
    said, is_toxic = got.score >= toxicity.THRESHOLD, got.toxic == 1
    assert (said & is_toxic).sum() / is_toxic.sum() > 0.85
    assert (said & ~is_toxic).sum() / (~is_toxic).sum() < 0.01
    assert got.score.between(0, 1).all()


def test_toxicity_edges(spark, docs, texts):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {toxicity.Model(None, None, 0, 1, 1, 0.0, -60.0).probability(np.zeros(1))[0]}
    words = ["vile", "plain"]
    train = [" ".join(["good day", words[i % 2], f"n{i}", f"m{i}"] * 3) for i in range(60)]
    model = toxicity.fit(train, np.array([1, 0] * 30))
    scored = {r.doc_id: r for r in toxicity.score_texts(table(spark, [None, "", "so vile. and (VILE!) now vile, vile", "plain talk " * 3000, "..."]), model).collect()}
    assert scored[2].score > 0.5 > max(scored[i].score for i in (0, 1, 3, 4))
    assert scored[2].passages and not scored[3].passages
    kept = toxicity.drop_toxic(table(spark, ["vile vile vile", "fine", None]), model)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == docs.columns
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


# ---- 4 mixing --------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, 170.0, 80.0] or sum(mixing.targets([100, 100, 100])) == pytest.approx(450)
    got = mixing.targets([10, 1000, 0, 500])
    assert got[0] == 20 and got[2] == 0 and sum(got) == pytest.approx(1.5 * 1510) and all(t <= 2 * s + 1e-9 for t, s in zip(got, [10, 1000, 0, 500], strict=True))
    assert mixing.targets([]) == []


def test_mixing(spark):
    rng = random.Random(1)
    texts = [" ".join(["w"] * rng.choice([0, 1, 5, 30, 200])) for _ in range(400)]
    docs = table(spark, texts)
    got = mixing.mix(docs, bucket_rows=16, fan=3).toPandas()
    again = mixing.mix(docs.repartition(7), bucket_rows=16, fan=3).toPandas()
    order = ["doc_id"]
    assert got.sort_values(order).taken.tolist() == again.sort_values(order).taken.tolist()
    assert len(got) == 400 and (got["size"] == [len(WORD.findall(texts[i])) for i in got.doc_id]).all()
    assert got.copies.isin([0, 1, 2]).all() and (got.taken <= 2 * got["size"]).all()
    by = got.groupby(got.source.fillna("-"), dropna=False).agg(target=("target", "max"), taken=("taken", "sum"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most).all()
    mixed = mixing.mixed(docs, bucket_rows=16, fan=3)
    assert mixed.columns == docs.columns and mixed.count() == int(got.copies.sum())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 50)), max_size=40), st.integers(0, 5))
def test_pivotal_steps_keep_the_words(units, seed):
    shares, sizes = [u[0] for u in units], [u[1] for u in units]
    out, at, p = mixing.pivot(list(range(1, len(units) + 1)), shares, sizes, seed)
    assert sum(x is None for x in out) == (at is not None)
    words = sum(x * s for x, s in zip(out, sizes, strict=True) if x is not None) + (p * sizes[at] if at is not None else 0)
    assert words == pytest.approx(sum(q * s for q, s in zip(shares, sizes, strict=True)), abs=1e-4)


def test_pivotal_rounding_keeps_probabilities():
    sizes, share = [9, 7, 5, 4, 2, 1, 1], 0.37
    taken = np.zeros(len(sizes))
    for seed in range(3000):
        out, at, p = mixing.pivot_pool(list(range(1, 8)), share, sizes, seed)
        taken += [p if x is None else x for x in out]
    assert np.abs(taken / 3000 - share).max() < 0.04


def test_mixing_edges(spark):
    docs = table(spark, ["a b", "a b", None, ""], [1, 1, None, None])
    assert mixing.mix(docs).count() == 4 and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0


# ---- 5 quality -------------------------------------------------------------------------


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_base_rules(spark, texts):
    more = [*texts, "a b c\n a b c\na b c\n\n\n", "## x | y & z <b>\n", "r s t u v " * 9]
    chain = quality.Chain(np.r_[1.0, np.zeros(len(quality.CUES) - 1)], np.zeros((2, 2)))
    for r in quality.judge(table(spark, more), chain).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == base_counts(more[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)
    assert quality.judge(table(spark, more).limit(0), chain).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_viterbi_is_the_best_path(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 7, 5)
    of_row = np.concatenate(([0], np.cumsum(sizes)))
    lines = quality.Lines(np.arange(of_row[-1] + 1), of_row, rng.normal(size=(of_row[-1], len(quality.CUES))))
    chain = quality.Chain(rng.normal(size=len(quality.CUES)), rng.normal(size=(2, 2)))
    label, score = quality.viterbi(chain, lines), lines.cues @ chain.cues
    worth = lambda path, a: sum(score[a + t] * x for t, x in enumerate(path)) + sum(chain.moves[p, q] for p, q in itertools.pairwise(path))
    for a, b in itertools.pairwise(of_row.tolist()):
        best = max((worth(p, a) for p in itertools.product((0, 1), repeat=b - a)), default=0)
        assert worth(label[a:b].astype(int).tolist(), a) == pytest.approx(best)
    p, pairs = quality._marginals(chain, lines, quality._ranks(of_row))
    for a, b in itertools.pairwise(of_row.tolist()):
        paths = [(q, np.exp(worth(q, a))) for q in itertools.product((0, 1), repeat=b - a)]
        for t in range(b - a):
            assert p[a + t] == pytest.approx(sum(w for q, w in paths if q[t]) / sum(w for _, w in paths))
    assert pairs.sum() == pytest.approx(sum(max(n - 1, 0) for n in sizes))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality(docs, labels).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")) & ~F.col("base_failed")).toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.97


# ---- 6 token output --------------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 65535)), max_size=400), max_size=6))
def test_blocks_round_trip(blocks):
    arrays = [np.array(b, np.uint32) for b in blocks]
    coded = R.encode_blocks(arrays)
    for own, back in zip(arrays, R.decode_blocks(coded), strict=True):
        assert own.tolist() == back.tolist()
    for own, code in zip(arrays, coded, strict=True):
        assert R.decode_blocks([code])[0].tolist() == own.tolist()  # a block needs no other


def test_damage_is_noticed():
    coded = R.encode_blocks([np.arange(500, dtype=np.uint32) % 37])[0]
    for at in (0, 5, 13, 17, len(coded) - 1):
        with pytest.raises(R.DamagedBlock):
            R.decode_blocks([coded[:at] + bytes([coded[at] ^ 4]) + coded[at + 1 :]])
    with pytest.raises(R.DamagedBlock):
        R.decode_blocks([coded[:-1]])
    with pytest.raises(ValueError):
        R.encode_blocks([np.array([1 << 16], np.uint32)])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=6))
def test_crc_of_pieces(parts):
    assert token_output.crc_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_token_files(spark, docs, texts, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_output.TOKENIZER)
    plain = Tokenizer.from_file(path)
    odd = ["<|endoftext|> A<|ENDOFTEXT|>b", "it's don't IT'S x!!y é.à 12ab3,4", "ẞ İstanbul.", "foo-bar_baz a<|endoftext|>", "ﬁne é."]
    more = [*texts, *odd]
    expected = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in more]
    got = {r.doc_id: r for r in token_output.encode_and_digest(table(spark, more)).collect()}
    start = 0
    for i, ids in enumerate(expected):
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), more[i]
        start += len(ids)
    folder = str(tmp_path / "ids")
    token_output.write_ids(table(spark, more), folder, path)
    assert {r.doc_id: r.ids for r in token_output.read_documents(spark, folder).collect()} == dict(enumerate(expected))
    assert token_output.encode_and_digest(table(spark, texts).limit(0)).count() == 0


# ---- 7 substring dedup -----------------------------------------------------------------


def test_substring_dedup(spark, docs, texts):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    removed = 0
    for r in substring_dedup.repeated_passages(docs, buckets=5).collect():
        w = words[r.doc_id]
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
        assert sum(s.stop - s.start for s in r.spans) == len(gone)
        removed += len(gone)
    assert removed > 500


def test_substring_dedup_edges(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "AUTOMATON_WORDS", 10)
    twice = table(spark, ["p " * 40, "p " * 40, None], [1, 1, None])
    assert sorted(r.n_removed for r in substring_dedup.repeated_passages(twice).collect()) == [0, 40, 40]
    assert substring_dedup.repeated_passages(twice.limit(0)).count() == 0


# ---- 8 URL filters ---------------------------------------------------------------------


def test_url_filters(spark):
    captures = spark.createDataFrame(
        [(1, "https://a.b.example.com/x/1", 5), (2, "https://a.b.example.com/x/1", 50), (3, "http://EXAMPLE.com:80/", 50), (4, "http://other.org/y", 9),
         (5, None, 9), (6, "no url", 9), (7, "http://other.org/y", None), (4, "http://other.org/y", 9), (8, "http://example.com", 10), (9, "http://example.com", 20)],
        "page_id long, url string, fetch_day int",
    ).withColumn("rule", F.lit("clash")).withColumn("salt", F.lit(1))
    entries = spark.createDataFrame(
        [("example.com", "block", 10), ("example.com", "remove", 20), ("example.com", "block", 30), ("a.b.example.com/x", "allow", 40), ("other.org", "block", 9),
         ("other.org", "remove", 9), (None, "block", 1), ("other.org", None, 1), ("other.org", "block", None)],
        "rule string, action string, day int",
    )
    rows = sorted((r.page_id, r.decision, r.matched_rule or "", r.listed_since or 0) for r in url_filters.judge(captures, entries).collect())
    assert rows == [
        (1, "keep", "", 0), (2, "allow", "a.b.example.com/x", 40), (3, "block", "example.com", 30), (4, "block", "other.org", 9), (4, "block", "other.org", 9),
        (5, "keep", "", 0), (6, "keep", "", 0), (7, "keep", "", 0), (8, "block", "example.com", 10), (9, "keep", "", 0),
    ]
    judged = url_filters.judge(captures, entries.limit(0))
    assert judged.columns[:5] == captures.columns and {r.decision for r in judged.collect()} == {"keep"}
    assert url_filters.judge(captures.limit(0), entries).count() == 0


# ---- 9 license scan --------------------------------------------------------------------


def test_license_scan(spark):
    gpl = "\n".join(license_scan.SENTENCES[i] for i in (11, 12, 13))
    texts = [
        "x\nReleased under the MIT License.\ny", "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", gpl, gpl.replace("\n", "\nsomething else.\n"),
        "\n".join(license_scan.SENTENCES[i] for i in (13, 12, 11)), None, "", "word " * 30_000, "released under the mit licenses",
    ]
    got = {r.doc_id: r for r in license_scan.scan(table(spark, texts)).collect()}
    assert [got[i].licenses for i in range(9)] == ["MIT", "Apache-2.0,CC-BY-NC-4.0", "GPL-header", "GPL-header", "", "", "", "", ""]
    assert got[3].sequence == "11,12,13" and got[5].n_sentences == 0 and got[7].n_sentences == 1
    assert license_scan.scan(table(spark, texts).limit(0)).count() == 0
    assert not any(re.match(license_scan.rule_pattern((1, 2)), s) for s in (",11,2,", ",1,22,"))
    assert re.search(license_scan.rule_pattern((1, 2)), ",5,1,7,9,2,")


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def test_license_scan_of_verbatim_notices(spark):
    notices = {
        MIT: "MIT-text", APACHE: "Apache-2.0,Apache-2.0-header", BSD2: "BSD-2-Clause", BSD2 + BSD3: "BSD-2-Clause,BSD-3-Clause", GPL: "GPL-header", MPL: "MPL-2.0", ISC: "ISC",
        BSD2 + BSD3.replace("copyright holder", "University of Somewhere, Inc."): "BSD-2-Clause,BSD-3-Clause",
        "Copyright X, licensed under the MIT License.": "MIT-notice", "This file is released under the MIT License.": "MIT", "Released under the\r\nMIT License - see LICENSE": "MIT",
        "unreleased under the MIT License": "", "not released under the MIT License": "", "released under the MIT License of X": "",
    }
    unwrapped = [" ".join(re.sub(r"\n[ ]*[#*]", "\n", n).split()) for n in notices]
    got = {r.doc_id: r.licenses for r in license_scan.scan(table(spark, [*notices, *unwrapped])).collect()}
    assert [got[i] for i in range(len(got))] == [*notices.values()] * 2
    full = license_scan.scan(table(spark, [MIT, APACHE, BSD2 + BSD3, GPL])).orderBy("doc_id").collect()
    assert [r.sequence for r in full] == ["3,4,5", "6,7,8,9", "17,18,19,20", "11,12,13"]


# ---- 10 near-dedup ---------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=50), min_size=1, max_size=20))
def test_xxh64(values):
    data = np.frombuffer(b"".join(values) + b"\0" * 8, np.uint8).copy()
    sizes = np.array([len(v) for v in values])
    assert H.xxh64_spans(data, np.cumsum(sizes) - sizes, sizes).tolist() == [xxhash.xxh64_intdigest(v, 42) for v in values]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.integers(0, 5))
def test_gray_forest_finds_all_links(seed, n, radius):
    rng = np.random.default_rng(seed)
    bits = np.unique(rng.choice(rng.integers(0, 2**63, 6).astype(np.uint64), n) ^ (np.uint64(1) << rng.integers(0, 6, n).astype(np.uint64)) ^ rng.integers(0, 4, n).astype(np.uint64))
    keys = rng.integers(0, 3, len(bits))
    forest = H.GrayForest(keys, bits, fan=int(rng.integers(2, 5)))
    order, got = forest.order, set()
    for leaf, low, high in forest.links(radius, frontier=64):
        for q, a, b in zip(leaf.tolist(), low.tolist(), high.tolist(), strict=True):
            got |= {frozenset((int(order[q]), int(order[x]))) for x in range(a, b)}
    assert got == {frozenset((a, b)) for a in range(len(bits)) for b in range(a) if keys[a] == keys[b] and (int(bits[a]) ^ int(bits[b])).bit_count() <= radius}


def brute_fingerprint(text):
    w = [x.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for x in (text or "").encode().split()]
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tree_rows", [3, 50_000])
def test_near_duplicates(spark, docs, texts, tree_rows):
    prints = [brute_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3 and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    got = near_dedup.near_duplicates(docs, tree_rows=tree_rows).withColumn("hex", near_dedup.fingerprint_hex(F.col("bits"))).collect()
    assert {r.doc_id: (r.hex, r.component_id) for r in got} == {i: (f"{p:016x}", root[i]) for i, p in enumerate(prints)}
    kept = near_dedup.keep_one(docs, tree_rows=tree_rows)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_near_duplicates_edges(spark):
    rows = table(spark, ["a b c d", "a b c d", None, "x y z w", "x y z w"], [4, 4, None, None, 9])
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(rows).collect()}
    assert got == {(4, 4), (None, None), (None, 9), (9, 9)}
    assert near_dedup.keep_one(rows).count() == 3
    assert near_dedup.near_duplicates(rows.limit(0)).count() == 0


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.comp for r in near_dedup.components(links).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokenizers_that_heed_case_or_white_space(name, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    mine, plain = token_output.WordTokenizer(path, 8), Tokenizer.from_file(path)
    assert (mine.by_words, mine.folds) == ((True, True) if name.startswith("word") else (False, False))
    some = [*texts, None, "Two  Words\n, THREE", " ".join(f"w{i}x" for i in range(300))]  # more distinct pieces than the cache holds
    ids, sizes = mine.encode(pa.array(some), 2)
    expected = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in some]
    assert ids.tolist() == [i for x in expected for i in x] and sizes.tolist() == [len(x) for x in expected]


def test_coder_learns(texts):
    """Order 0 learns which ids a block has and beats zlib on loose ones; orders 1 and 2 learn what follows."""
    rng = np.random.default_rng(3)
    vocabulary = rng.integers(0, 49_000, 600)
    loose = vocabulary[np.minimum(rng.zipf(1.3, R.BLOCK_IDS * 3) - 1, 599)].astype(np.uint32)
    cycle = np.tile(vocabulary[:50], R.BLOCK_IDS // 50 + 1)[: R.BLOCK_IDS].astype(np.uint32)
    blocks = [*np.split(loose, 3), cycle]
    coded = R.encode_blocks(blocks)
    for own, code in zip(blocks[:3], coded, strict=False):
        assert len(code) < len(zlib.compress(own.astype("<u2").tobytes(), 9))
    assert len(coded[-1]) < 0.1 * len(cycle)
    assert all((a == b).all() for a, b in zip(blocks, R.decode_blocks(coded), strict=True))


def test_a_task_is_one_batch(monkeypatch):
    """A task's blocks (about 3,100 at 0.5 GB) are coded and decoded in one run of steps, in order, whatever their sizes and ids."""
    rng = np.random.default_rng(8)
    sizes = [*rng.integers(0, 12, 3400), 700, R.BLOCK_IDS, R.BLOCK_IDS, R.BLOCK_IDS]
    blocks = [rng.integers(0, 1 << 16, n).astype(np.uint32) for n in sizes]
    blocks[-1] = np.arange(R.BLOCK_IDS, dtype=np.uint32) + 60_000  # an id comes once: order 0 has a row for each
    blocks[-2] = np.repeat(np.uint32(65_535), R.BLOCK_IDS)
    runs = []
    made = R._Model.__init__
    monkeypatch.setattr(R._Model, "__init__", lambda self, lanes: (runs.append(lanes), made(self, lanes))[1])
    back = R.decode_blocks(R.encode_blocks(blocks))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back, strict=True))
    assert runs == [len(blocks), len(blocks)]


def test_pieces_are_the_words_cut_before_punctuation():
    marks = set("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
    column = pa.array(["Don't, stop-it.", None, "", ",a a, b;c,d é, x1, <|A|>", "  (w) Ab,\n"])
    for some in (column, column.slice(4)):
        pieces = token_output.cut_pieces(some)
        raw = pieces.data.tobytes()
        got = [[raw[a:b].decode() for a, b in zip(pieces.starts[i:j], pieces.ends[i:j], strict=True)] for i, j in itertools.pairwise(pieces.first.tolist())]
        fold = str.lower if len(some) == 1 else str
        want = []
        for text in some.to_pylist():
            want.append([])
            for word in (text or "").split():
                at = next((i for i, c in enumerate(word) if c.isascii() and not c.isalpha()), len(word))
                cut = 0 < at < len(word) and word[at - 1].isascii() and word[at] in marks
                want[-1] += [fold(word[:at]), fold(word[at:])] if cut else [fold(word)]
        assert got == want


def covered_by_repeats(texts, width):
    """The words of each text that a window covers whose words start anywhere else too."""
    words = [t.split() for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    return [sorted({j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}) for w in words]


def located(texts, width, buckets):
    """All steps of substring dedup on dealt texts, without Spark."""
    S, dealt = substring_dedup, [[i for i in range(len(texts)) if i % buckets == b] for b in range(buckets)]
    group = lambda b: pa.table({"doc_id": pa.array(dealt[b], pa.int64()), "text": pa.array([texts[i] for i in dealt[b]], pa.string()), "bucket": pa.array([b] * len(dealt[b]), pa.int32())})

    def by(name, tables):
        rows = pa.concat_tables(tables)
        return {k: rows.filter(pa.compute.equal(rows[name], k)) for k in set(rows[name].to_pylist())}

    full = [b for b in range(buckets) if dealt[b]]
    told = by("bucket", [S._meet_anchors(g) for g in by("hash_range", [S._ship_anchors(width, 3)(group(b)) for b in full]).values()] or [S._table([], S._TOLD)])
    candidates = by("hash_range", [S._ship_candidates(width, 3)(group(b), told.get(b, S._table([], S._TOLD))) for b in full])
    asked = by("bucket", [S._pair(g) for g in candidates.values()] or [S._table([], S._ASKED)])
    passages = by("bucket", [S._answer(width)(group(b), asked.get(b, S._table([], S._ASKED))) for b in full])
    out = {}
    for b in full:
        result = S._strip(width)(group(b), passages.get(b, S._table([], S._PASSAGES)))
        out |= {r["doc_id"]: [j for s in r["spans"] for j in range(s["start"], s["stop"])] for r in result.to_pylist()}
    return [out[i] for i in range(len(texts))]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=8), st.integers(2, 7), st.integers(1, 4))
def test_every_repeat_is_located(texts, width, buckets):
    texts = [" ".join(t) for t in texts]
    assert located(texts, width, buckets) == covered_by_repeats(texts, width)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=40), min_size=2, max_size=8), st.integers(2, 6))
def test_equal_hashes_remove_nothing(texts, width):
    """With hashes of windows, phrases and words that all collide, what is removed still has its words elsewhere."""
    texts = [" ".join(t) for t in texts]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(T, "shingle_hashes", lambda h, k: np.zeros(max(len(h) - k + 1, 0), np.uint64))
        patch.setattr(T.Words, "hashes", lambda self: np.zeros(len(self.starts), np.uint64))
        found = located(texts, width, 3)
    assert all(set(a) <= set(b) for a, b in zip(found, covered_by_repeats(texts, width), strict=True))


def test_automata_decide(monkeypatch):
    """What no automaton finds stays."""
    texts = [" ".join(f"w{i}" for i in range(60))] * 3
    assert all(located(texts, 35, 2))
    monkeypatch.setattr(substring_dedup, "_automata", lambda passages, ids: iter(()))
    assert not any(located(texts, 35, 2))


def test_segments_take_linear_time():
    import time

    def seconds(n):
        scores = np.tile(np.array([300, -700, 200, -100], np.int64), n // 4)
        began = time.perf_counter()
        assert len(toxicity.segments(scores)) >= n // 4
        return time.perf_counter() - began

    seconds(1000)
    assert min(seconds(160_000) for _ in range(3)) < 2.5**4 * min(seconds(10_000) for _ in range(3)) + 0.05


def test_whole_toxicity_score():
    """Score, evidence and passages of every text, from words and the model's numbers alone."""
    rng = random.Random(11)
    mild, vile = [f"day{i}" for i in range(60)], [f"vile{i}x" for i in range(8)]
    make = lambda bad: " ".join(rng.choice(vile if bad and rng.random() < 0.4 else mild) + rng.choice(["", ".", "!?!?!?"]) for _ in range(rng.randint(1, 30)))
    train = [make(i % 3 == 0) for i in range(150)]
    toxic = np.array([int(i % 3 == 0) for i in range(150)])
    model = toxicity.fit(train, toxic, 0.1)
    own = dict(zip(model.words.tolist(), model.scores.tolist(), strict=True))
    texts = [make(i % 2) for i in range(60)] + ["", None, "...", " ".join(vile * 20)]
    words = toxicity.plain_words(pa.array(texts))
    x, passages = toxicity.evidence_of(model, model.word_scores(*toxicity.terms(words)), words.first)
    for text, got, found in zip(texts, x, passages, strict=True):
        plain = [re.sub(r"(?<=.)[!-/:-@\[-`{-~]+\Z", "", re.sub(r"\A[!-/:-@\[-`{-~]+(?=.)", "", w.lower())) for w in WORD.findall(text or "")]
        keys = [tuple(k[0] for k in toxicity.terms(T.cut_words(pa.array([w])))) for w in plain]
        scores = [own.get(int(whole), own.get(int(stem), model.common)) for whole, stem in keys]
        expect = lambda s: model.k * max(len(scores), 1) * np.exp(-model.lam * s / 1000)  # noqa: B023, E731
        every = [(a, b, s, expect(s)) for a, b, s in all_segments(scores)]
        best = max((s for *_, s, _ in every), default=0)
        want = max(0.0, -np.log(expect(best))) if best else 0.0
        good = [e for e in every if e[3] < model.significant]
        want = max(want, sum(-np.log(max(e[3], 1e-300)) for e in good)) if good else want
        assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert [(p["start"], p["stop"]) for p in found] == [(a, b) for a, b, _, _ in good]
    assert model.probability(x)[-1] > 0.5 > model.probability(x)[-3]


def test_no_word_edge_is_cut_short():
    words = toxicity.plain_words(pa.array(["(((((vile)))))))", "!" * 50, "a" + "." * 30, None]))
    assert [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)] == [b"vile", b"!", b"a"]


def test_items_are_pruned_and_recalled():
    """Candidates among unrelated fingerprints, and recall of windows at the least similarity that counts."""
    rng = np.random.default_rng(9)
    prints = rng.integers(0, 1 << 64, 2000, np.uint64)
    items = decontamination.Items(5, 5, list(range(2000)), [], prints, 1)
    asked = rng.integers(0, 1 << 64, 300, np.uint64)
    assert len(items.candidates(asked, decontamination.RADIUS)) < 0.05 * 300 * 2000
    found = []
    for _ in range(300):  # of 160 shingles 18 differ: similarity 0.798; 17: 0.808
        a = rng.integers(0, 1 << 64, 160, np.uint64)
        b = np.concatenate([a[17:], rng.integers(0, 1 << 64, 17, np.uint64)])
        x, y = H.majority_bits(np.concatenate([a, b]), np.array([0, 160, 320]))
        found.append((int(x) ^ int(y)).bit_count() <= decontamination.RADIUS)
    assert np.mean(found) > 0.97


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=6, max_size=6), st.lists(st.integers(0, 4), min_size=6, max_size=6)), min_size=1, max_size=5))
def test_weighted_similarity(pairs):
    a, b = (decontamination.as_sets(np.array([p[i] for p in pairs], np.uint64)) for i in (0, 1))
    for got, (x, y) in zip(decontamination.similarities(a, b), pairs, strict=True):
        common = (Counter(x) & Counter(y)).total()
        assert got == common / (12 - common)


# ---- names, frequent keys, whole plans ---------------------------------------------------------

ODD = ("__id", "__copies", "__key", "__n", "a.b", "host", "row", "n", "copies", "times", "own_id", "bits", "segment", "decision", "salt", "x`y")


def with_odd_names(docs):
    return docs.select("*", *(F.lit(name).alias(name) for name in ODD if name not in docs.columns))


@pytest.mark.parametrize("operator", ["mixed", "keep_one", "decontaminate", "drop_toxic", "judge"])
def test_no_name_clashes(spark, operator):
    docs = with_odd_names(table(spark, ["a b c", "a b c", "other words here", None, ""], [1, 2, None, 4, 4]))
    bench = spark.createDataFrame([(1, "other words here")], "item_id long, text string")
    if operator == "judge":
        pages = with_odd_names(spark.createDataFrame([(1, "http://a.example.com/x", 5), (2, None, 5)], "page_id long, url string, fetch_day int"))
        entries = spark.createDataFrame([("example.com", "block", 1)], "rule string, action string, day int")
        got = url_filters.judge(pages, entries)
        assert got.columns == [*pages.columns, "host_", "decision_", "matched_rule", "listed_since"]
        assert {r["page_id"]: (r["decision_"], r["host_"], r["a.b"]) for r in got.collect()} == {1: ("block", "a.example.com", "a.b"), 2: ("keep", None, "a.b")}
        return
    got = {
        "mixed": lambda: mixing.mixed(docs), "keep_one": lambda: near_dedup.keep_one(docs), "decontaminate": lambda: decontamination.decontaminate(docs, bench),
        "drop_toxic": lambda: toxicity.drop_toxic(docs, toxicity.fit([], np.array([]))),
    }[operator]()
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[name] == (r["bits"] if name == "bits" else name) for r in rows for name in ODD)
    if operator == "keep_one":
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 1), (False, 4), (True, 0)]


def test_frequent_fingerprints_and_probes(spark, monkeypatch):
    """Copies that make most of the rows, looked up in place, next to rare ones that are dealt."""
    texts = ["the very same words in every copy"] * 60 + [f"w{i} x{i} y{i} z{i}" for i in range(40)]
    for part in (1024, 3, 10**9):
        monkeypatch.setattr(near_dedup, "FREQUENT", part)
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
        assert len(got) == 100 and {got[i] for i in range(60)} == {0} and all(got[i] <= i for i in got)
        monkeypatch.setattr(url_filters, "FREQUENT", part)
        rows = [(i, "http://a.hot.example.com/x" if i % 3 else f"http://h{i}.example.com/", 10) for i in range(90)]
        entries = [("example.com", "block", 1), ("example.com", "remove", 5), ("hot.example.com", "block", 7), ("a.hot.example.com/x", "allow", 11), *[(f"h{i}.example.com", "block", 10) for i in range(0, 90, 6)]]
        answers = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, fetch_day int"), spark.createDataFrame(entries, "rule string, action string, day int"))
        said = {r.page_id: (r.decision, r.matched_rule) for r in answers.collect()}
        assert said == {i: ("block", "hot.example.com") if i % 3 else ("block", f"h{i}.example.com") if i % 6 == 0 else ("keep", None) for i in range(90)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=40), st.sampled_from([0.5, 1.5, 1.9, 2.5]))
def test_targets_by_rounds(sizes, epochs):
    """Targets by repeated sharing: what full sources cannot take goes to the others until none is above."""
    weights, most = mixing.WEIGHTS, 2.0
    want, free = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n]
    left = epochs * sum(sizes)
    while free:
        share = left / sum(weights[i % 3] for i in free)
        over = [i for i in free if share * weights[i % 3] >= most * sizes[i]]
        for i in over or free:
            want[i] = most * sizes[i] if over else share * weights[i % 3]
        if not over:
            break
        left -= sum(want[i] for i in over)
        free = [i for i in free if i not in over]
    assert mixing.targets(sizes, epochs=epochs) == pytest.approx(want)
    if len(sizes) > 0:
        assert sum(want) == pytest.approx(min(epochs, most) * sum(sizes))


def test_any_number_of_sources(spark, monkeypatch):
    """Plans made on the driver and as a table are the same."""
    rng = random.Random(4)
    names = [None, "é", "z", "A", "a", *(f"s{i}" for i in range(40)), "\U0001f600"]
    rows = [(n, rng.choice([0, 3, 50, 900]), 1) for n in names]
    per = spark.createDataFrame(rows, "source string, source_size long, rows long").repartition(5)
    listed = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    want = {r[0]: (i, aim) for i, (r, aim) in enumerate(zip(listed, mixing.targets([r[1] for r in listed]), strict=True))}
    assert {r.source: (r.place, r.target) for r in mixing.target_table(per).collect()} == want
    docs = table(spark, [" ".join(["w"] * rng.randint(0, 40)) for _ in range(60)])
    one = sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "target", "taken").collect())
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 0)
    assert sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "target", "taken").collect()) == one


def test_whole_mix(spark):
    """Every document's copies, by pivotal steps over each source's documents from the largest on, one pair at a time."""
    rng = random.Random(8)
    docs = table(spark, [" ".join(["w"] * rng.choice([0, 2, 7, 31, 90])) for _ in range(120)])
    seed, got = 17, {r.doc_id: r for r in mixing.mix(docs, bucket_rows=10**6).collect()}
    keyed = docs.select("doc_id", "source", F.size(F.split("text", " ")).alias("n"), F.xxhash64("text").alias("text_key"), "text").collect()
    sources = sorted({r.source for r in keyed}, key=lambda s: (s is None, s or ""))
    sizes = {r.doc_id: len((r.text or "").split()) for r in keyed}
    totals = [sum(sizes[r.doc_id] for r in keyed if r.source == s) for s in sources]
    for place, (source, total, aim) in enumerate(zip(sources, totals, mixing.targets(totals), strict=True)):
        rate = aim / total
        base, share = int(rate + 1e-9), max(0.0, rate - int(rate + 1e-9))
        own = spark.createDataFrame([(r.doc_id, r.text_key) for r in keyed if r.source == source], "doc_id long, text_key long")
        keys = {r.doc_id: r.k for r in own.select("doc_id", F.xxhash64("doc_id", "text_key", F.lit(place).cast("long"), F.lit(0).cast("long"), F.lit(seed)).alias("k")).collect()}
        order = sorted(keys, key=lambda d: (sizes[d], keys[d]), reverse=True)
        p = {d: share for d in order}
        fixed, waiting = {}, None
        for d in order:
            if p[d] < mixing.TINY or p[d] > 1 - mixing.TINY:
                fixed[d] = int(p[d] > 0.5)
            elif sizes[d] == 0:
                fixed[d] = int(mixing._uniform(keys[d] % 2**64, 0, seed) < p[d])
            elif waiting is None:
                waiting = d
            else:
                a, b = waiting, d
                up, down = min((1 - p[a]) * sizes[a], p[b] * sizes[b]), min(p[a] * sizes[a], (1 - p[b]) * sizes[b])
                move = up if mixing._uniform(keys[a] % 2**64, keys[b] % 2**64, seed) * (up + down) < down else -down
                p[a], p[b] = p[a] + move / sizes[a], p[b] - move / sizes[b]
                for x in (a, b):
                    if p[x] < mixing.TINY or p[x] > 1 - mixing.TINY:
                        fixed[x] = int(p[x] > 0.5)
                waiting = next((x for x in (a, b) if x not in fixed), None)
        if waiting is not None:  # the tree's only node draws with the seed of its depth
            fixed[waiting] = int(mixing._uniform(keys[waiting] % 2**64, 0, seed + 1) < p[waiting])
        assert {d: got[d].copies for d in order} == {d: base + fixed[d] for d in order}
        assert abs(sum(got[d].taken for d in order) - aim) <= max(sizes[d] for d in order)


def test_long_documents_train_too():
    lines = ["Good sentences end with a stop and have some length.", "### ||| ###"]
    texts = ["\n".join(lines[i % 2] for _ in range(900)) for i in range(20)]
    words = T.cut_words(pa.array(texts))
    read = quality.read_lines(words, words.hashes(), quality.repeats(words))
    pieces, good = quality.in_pieces(read, np.array([1, 0] * 10))
    assert np.diff(pieces.of_row).max() <= quality.PIECE_LINES and np.diff(pieces.of_row).sum() == 20 * 900 and len(good) == 20 * 5
    chain = quality.fit_texts(texts, np.array([1, 0] * 10))
    short = T.cut_words(pa.array(["Another sentence of some length ends here.\n### ||| ###"]))
    assert quality.viterbi(chain, quality.read_lines(short, short.hashes(), quality.repeats(short))).tolist() == [True, False]


def test_samples_are_bounded_and_one_text_an_id(spark):
    docs = spark.createDataFrame([(i % 30, "z" * 50 + f" w{i}") for i in range(60)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] + [(3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    texts, toxic, share = toxicity.sample(docs, labels)
    assert len(texts) == len(set(texts)) == len(toxic) and 0.3 < share < 0.7
    few, _, _ = toxicity.sample(docs, labels, chars=200)
    assert sum(map(len, few)) <= 200 and few
    assert len(quality.sample(docs, labels, chars=200)[0]) == len(few)


def test_no_folder_is_made_up_on_a_cluster():
    from weblode.llm import spark_io

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
        getConf = staticmethod(lambda: {})  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        spark_io.shared_folder(type("Session", (), {"sparkContext": Context})())


@pytest.mark.parametrize("ids", [[1, 1, 1], [None, None, 2], [5, 5, None]])
def test_equal_and_null_ids(spark, ids):
    """Repeated ids, repeated rows and null ids: each row is answered."""
    docs = table(spark, ["released under the mit license", "released under the mit license", "other"], ids)
    model = toxicity.fit([], np.array([]))
    bench = spark.createDataFrame([(7, "other"), (None, "the mit")], "item_id long, text string")
    assert toxicity.score_texts(docs, model).count() == 3
    assert quality.judge(docs, quality.fit_texts([], np.array([]))).count() == 3
    assert sorted(r.licenses for r in license_scan.scan(docs).collect()) == ["", "MIT", "MIT"]
    assert len(decontamination.matches(docs, bench).collect()) == 3
    rows = sorted(token_output.encode_and_digest(docs).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(3)]
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sharding.shard_documents(docs).count() == 3
