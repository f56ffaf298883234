"""Token-ID output in blocks of an adaptive context-mixing range coder (op 6).

Documents are dealt by ranges of doc_id and sorted, so the parts in order hold the documents in
ascending id. Each part's ids (a public tokenizer's, with an end id after each document) are
cut into blocks of BLOCK_IDS regardless of documents; a block is coded on its own and carries
its checksum. A file row is one block: its part and number, the ids before it in its part,
the payload, and which documents its ids belong to, so any block can be read alone.

Reading decodes blocks where they lie, in lockstep; only documents cut by a block's edge
meet again, as CRC pieces that are combined without their ids.

Text is tokenized by words: white space always separates tokens of the tokenizers used here, so
each distinct word is encoded once by the library and its ids are kept in a bounded cache, under
a 64-bit hash of its bytes (among n distinct words about n^2 / 2^65 pairs collide). Words go in
lower case only if the tokenizer is found to lower-case.

Defined results: a null or empty text has only the end id; long texts run over many blocks;
equal ids are ordered by a hash of their text, null ids come first; repeated rows are written
each; an empty table writes no block and reads back empty; other columns are not read.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from weblode.llm import range_coder as R, text as T
from weblode.llm.spark_io import checkpointed, shared_folder

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Words whose ids a worker keeps.
CACHE_WORDS = 1 << 20
#: Text bytes tokenized at once: word arrays take some twenty bytes for each.
SLICE_BYTES = 1 << 20
BLOCKS = (
    "part int, block int, first long, n_ids int, payload binary, doc_no long, resumes boolean, doc_ids array<long>, doc_sizes array<int>"
)
PIECES = "part int, doc_no long, doc_id long, piece int, lone boolean, first long, n long, crc long"


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CLOSED = ~_LETTER
_CLOSED[128:] = False
# ASCII punctuation that always starts a token after a letter; an apostrophe may belong to a contraction.
_CUT = np.zeros(256, bool)
_CUT[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_SAMPLES = ("The", "river", "ABC", "Xylophone", "tokenization", "ÉTÉ")
_LETTERS = regex.compile(r"\p{L}+")


def _letters(text: str) -> bool:
    return bool(_LETTERS.fullmatch(text)) and unicodedata.is_normalized("NFC", text)


def cut_pieces(column: pa.Array, folds: bool = True) -> T.Words:
    """Words, those of the form letters + punctuation cut in two; ASCII in lower case if the tokenizer has it so.

    Neither changes any token: a letter and a punctuation mark never share one. Texts that may
    spell a special token, which is sensitive to case, are left as they are.
    """
    words = T.cut_words(column)
    data = T.lower_ascii(words.data) if folds and b"<|" not in words.data.tobytes() else words.data
    closed = _CLOSED.take(data)
    other = np.flatnonzero(closed)  # the padding ends every search
    at = other.take(np.cumsum(closed, dtype=np.int32).take(words.starts) - closed.take(words.starts))
    word = np.flatnonzero((at < words.ends) & (at > words.starts))
    cut = at.take(word)
    in_two = _LETTER.take(data.take(cut - 1)) & _CUT.take(data.take(cut))
    word, cut = word[in_two], cut[in_two]
    # A word moves up by the words before it that are cut, and its second half follows it.
    second = word + np.arange(1, len(word) + 1)
    whole = np.ones(len(words.starts) + len(word), bool)
    whole[second] = False
    starts, ends = np.empty(len(whole), np.int64), np.empty(len(whole), np.int64)
    starts[whole], ends[whole] = words.starts, words.ends
    starts[second], ends[second], ends[second - 1] = cut, words.ends.take(word), cut
    return T.Words(data, words.rows, starts, ends, np.searchsorted(starts, words.rows))


class WordTokenizer:
    """Ids of texts by way of their distinct pieces; exact for tokenizers that never join words across white space."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        plain = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.folds = all(plain(w) == plain(w.lower()) for w in _SAMPLES)
        # Whether words and cut pieces can be encoded apart; a tokenizer that heeds white space encodes whole texts.
        self.by_words = all(plain(f"{v} \n{w},") == plain(v) + plain(w) + plain(",") for v, w in itertools.product(_SAMPLES, repeat=2))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self, pieces: int = 0) -> None:
        """Forgets all pieces and makes room for `cache_words`, or for as many as are to come at once."""
        # An open hash table: slot of a piece by its hash (never 0), then where its ids begin and how many they are.
        places = 2 << (max(self.cache_words, pieces) - 1).bit_length()
        self.keys, self.slots = np.zeros(places, np.uint64), np.zeros(places, np.int32)
        self.begin, self.size = np.empty(0, np.int32), np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each piece, -1 if it is not known."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(hashes), -1, np.int64)
        todo, at = np.arange(len(hashes)), (hashes & mask).astype(np.int64)
        while len(todo):
            there = self.keys.take(at, mode="wrap")
            hit = there == hashes.take(todo, mode="wrap")
            out[todo] = np.where(hit, self.slots.take(at, mode="wrap"), -1)
            on = np.flatnonzero(~hit & (there != 0))
            todo, at = todo.take(on), (at.take(on) + 1) & int(mask)
        return out

    def _insert(self, hashes: np.ndarray) -> None:
        """Puts distinct new pieces in, with the next slots in order."""
        mask = len(self.keys) - 1
        todo, at = np.arange(len(hashes)), (hashes & np.uint64(mask)).astype(np.int64)
        base = len(self.begin)
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[todo[free]]  # of several at one place the last stays
            mine = self.keys[at] == hashes[todo]
            self.slots[at[mine]] = base + todo[mine]
            todo, at = todo[~mine], (at[~mine] + 1) & mask

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of single words, by one call on all of them: each ends with the word's last token."""
        runs = [b" ".join(spans[i : i + 4096]).decode() for i in range(0, len(spans), 4096)]
        ids = np.array([i for x in self._encode(runs) for i in x], np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(spans):  # a tokenizer that cuts these words further, or does not mark their ends
            lists = self._encode([w.decode() for w in spans])
            return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)
        return ids, np.diff(last, prepend=-1)

    def _learn(self, new: np.ndarray, spans: list[bytes]) -> None:
        # Words of letters alone go in runs; ASCII ones show it in their bytes, others need a look.
        plain = np.array([w.isalpha() if w.isascii() else _letters(w.decode("utf-8", "replace")) for w in spans], bool)
        ids, sizes = self._encode_words(list(itertools.compress(spans, plain.tolist()))) if plain.any() else (np.empty(0, np.uint32), np.empty(0, np.int64))
        rest = self._encode([w.decode("utf-8", "replace") for w in itertools.compress(spans, (~plain).tolist())])
        size = np.zeros(len(spans), np.int64)
        size[plain] = sizes
        size[~plain] = [len(x) for x in rest]
        ids = np.concatenate([ids, np.array([i for x in rest for i in x], np.uint32)])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        at = np.empty(len(spans), np.int64)
        at[order] = len(self.ids) + np.cumsum(size[order]) - size[order]
        self._insert(new)
        self.ids = np.concatenate([self.ids, ids])
        self.begin, self.size = np.concatenate([self.begin, at.astype(np.int32)]), np.concatenate([self.size, size.astype(np.int32)])

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with an end id after each text, and the number of each text's ids."""
        if not self.by_words:
            lists = [[*x, end_id] for x in self._encode([t or "" for t in column.to_pylist()])]
            return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)
        words = cut_pieces(column, self.folds)
        hashes = np.maximum(words.hashes(), np.uint64(1))
        slot = self._find(hashes)
        new = np.flatnonzero(slot < 0)
        if len(new):
            distinct, first = np.unique(hashes[new], return_index=True)
            if len(self.begin) + len(distinct) > self.cache_words:
                distinct, first = np.unique(hashes, return_index=True)
                self._clear(len(distinct))
                new = np.arange(len(hashes))
            first, raw = new[first], words.data.tobytes()
            self._learn(distinct, [raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)])
            slot[new] = self._find(hashes[new])
        size, start = (x.take(slot, mode="wrap").astype(np.int64) for x in (self.size, self.begin))
        totals = T.row_sums(size, words.first) + 1
        stop = np.cumsum(totals)
        out = np.full(int(totals.sum()), end_id, np.uint32)
        inner = np.ones(len(out), bool)
        inner[stop - 1] = False
        out[inner] = self.ids.take(np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum())), mode="wrap")
        return out, totals


_workers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer, with its cache, for each Python worker."""
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]


def _file_rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tokenizer = tokenizer_of(path)
        schema = pa.schema(
            [
                ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("payload", pa.binary()),
                ("doc_no", pa.int64()), ("resumes", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int32())),
            ]
        )
        held, held_n = [], 0
        open_docs: list[list] = []  # [doc_id, ids not yet written], in order; the first may be begun
        begun, doc_no, block, first = False, 0, 0, 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, held_n, begun, doc_no, block, first, open_docs
            ids = np.concatenate(held) if held else np.empty(0, np.uint32)
            whole = len(ids) if last else len(ids) - len(ids) % R.BLOCK_IDS
            cut = [ids[i : min(i + R.BLOCK_IDS, whole)] for i in range(0, whole, R.BLOCK_IDS)]
            held, held_n = [ids[whole:]], len(ids) - whole
            rows, at = [], 0
            for payload, own in zip(R.encode_blocks(cut), cut, strict=True):
                left, start_no, resumes, names, sizes = len(own), doc_no, begun, [], []
                while left:
                    doc = open_docs[at]
                    n = min(left, doc[1])
                    names.append(doc[0])
                    sizes.append(n)
                    left -= n
                    doc[1] -= n
                    begun = doc[1] > 0
                    if not begun:
                        at += 1
                        doc_no += 1
                rows.append((part, block, first, len(own), payload, start_no, resumes, names, sizes))
                block, first = block + 1, first + len(own)
            open_docs = open_docs[at:]
            for i in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows[i : i + 512], strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for some in T.slices(batch, "text", SLICE_BYTES):
                ids, sizes = tokenizer.encode(some.column("text"), end_id)
                held.append(ids)
                held_n += len(ids)
                open_docs += [list(x) for x in zip(some.column("doc_id").to_pylist(), sizes.tolist(), strict=True)]
                if held_n >= R.BLOCK_IDS * R.LANES:
                    yield from flush(False)
        if held_n:
            yield from flush(True)

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Writes the documents' ids, in ascending doc_id, to a table of blocks in a folder that all executors share."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    # The row's place in its split is the last key, so that rows equal in everything are not one task's.
    texts = texts.withColumn("place", F.monotonically_increasing_id())
    dealt = texts.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place").drop("tie", "place")
    dealt.mapInArrow(_file_rows(tokenizer_path, end_id), BLOCKS).write.mode("overwrite").option("compression", "uncompressed").parquet(folder)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(folder)


def _decoded(batches: Iterator[pa.RecordBatch], most: int = R.LANES) -> Iterator[tuple[dict, np.ndarray]]:
    """Each block's row and its ids, decoded `most` blocks at once."""
    held: list[dict] = []
    for batch in batches:
        held += batch.to_pylist()
        while len(held) >= most:
            yield from zip(held[:most], R.decode_blocks([r["payload"] for r in held[:most]]), strict=True)
            held = held[most:]
    if held:
        yield from zip(held, R.decode_blocks([r["payload"] for r in held]), strict=True)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids) of every document, decoded from the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for row, ids in _decoded(batches):
            cuts = np.cumsum([0, *row["doc_sizes"]])
            n = len(row["doc_ids"])
            yield pa.RecordBatch.from_pylist(
                [{"part": row["part"], "doc_no": row["doc_no"] + i, "block": row["block"], "doc_id": row["doc_ids"][i], "ids": ids[cuts[i] : cuts[i + 1]].astype(np.int32)} for i in range(n)],
                pa.schema([("part", pa.int32()), ("doc_no", pa.int64()), ("block", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]),
            )

    pieces = read_blocks(spark, folder).mapInArrow(run, "part int, doc_no long, block int, doc_id long, ids array<int>")
    joined = pieces.groupBy("part", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("block", "ids"))).alias("pieces"))
    return joined.select("doc_id", F.flatten(F.col("pieces.ids")).alias("ids"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The CRC and length of each document's piece in each block."""
    names = [c.split()[0] for c in PIECES.split(",")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    rows: list[tuple] = []

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for row, ids in _decoded(batches):
        raw, at = ids.astype("<u4").tobytes(), 0
        last = len(row["doc_ids"]) - 1
        for i, (doc, n) in enumerate(zip(row["doc_ids"], row["doc_sizes"], strict=True)):
            # A piece at either edge of its block may have others; the ones between are whole.
            lone = 0 < i < last
            rows.append((row["part"], row["doc_no"] + i, doc, row["block"], lone, row["first"] + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])))
            at += n
        if len(rows) > 20_000:
            yield pack()
            rows = []
    if rows:
        yield pack()


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the reflected CRC-32 polynomial, element by element."""
    a, b = (np.asarray(x, np.uint32) for x in (a, b))
    out, one, polynomial = np.zeros(np.broadcast(a, b).shape, np.uint32), np.uint32(1), np.uint32(0xEDB88320)
    for i in range(31, -1, -1):
        out ^= b * ((a >> np.uint32(i)) & one)
        b = (b >> one) ^ (polynomial * (b & one))
    return out


def _x_powers(n_bytes: np.ndarray) -> np.ndarray:
    """x^(8 n) modulo the CRC-32 polynomial, in the reflected form that zlib uses."""
    left, square = np.asarray(n_bytes, np.uint64).copy(), np.uint32(1 << 23)
    out = np.full(left.shape, 1 << 31, np.uint32)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] = _times(out[odd], square)
        square, left = _times(square, square), left >> np.uint64(1)
    return out


def crcs_joined(crcs: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of the concatenation of each row's pieces, from the pieces' CRC-32 and bytes; rows by offsets.

    A row's CRC is the sum of its pieces' CRCs, each moved by the bytes that follow it.
    """
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    behind = np.repeat(total[first[1:]], np.diff(first)) - total[1:]
    moved = _times(_x_powers(behind), crcs)
    out = np.zeros(len(first) - 1, np.uint32)
    full = np.flatnonzero(np.diff(first))
    out[full] = np.bitwise_xor.reduceat(moved, first[full]) if len(full) else 0
    return out


def crc_joined(pieces: list[tuple[int, int]]) -> int:
    """CRC-32 of the concatenation, from each piece's (CRC-32, bytes)."""
    crcs, sizes = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1))
    return int(crcs_joined(crcs.astype(np.uint32), sizes, np.array([0, len(pieces)]))[0])


@F.pandas_udf(LongType())
def _joined_crc(crcs: pd.Series, sizes: pd.Series) -> pd.Series:
    first = np.concatenate(([0], np.cumsum([len(c) for c in crcs], dtype=np.int64)))
    flat = [np.concatenate(x.to_list()) if len(x) else np.empty(0, np.int64) for x in (crcs, sizes)]
    return pd.Series(crcs_joined(flat[0].astype(np.uint32), 4 * flat[1].astype(np.int64), first).astype(np.int64))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    blocks = read_blocks(spark, folder)
    # One row a part: as many as the writer had tasks.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    base, before = [], 0
    for row in sorted(totals, key=lambda r: r["part"]):
        base.append((row["part"], before))
        before += row["n"]
    parts = spark.createDataFrame(base, "part int, base long")
    pieces = checkpointed(blocks.mapInArrow(_digest, PIECES))  # decoded once, read twice below
    lone = pieces.where("lone").select("part", "doc_id", "first", "n", "crc")
    cut = pieces.where("not lone").groupBy("part", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("piece", "first", "n", "crc"))).alias("at"))
    whole = cut.select(
        "part", "doc_id", F.col("at")[0]["first"].alias("first"), F.aggregate("at.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"),
        F.when(F.size("at") == 1, F.col("at")[0]["crc"]).otherwise(_joined_crc("at.crc", "at.n")).alias("crc"),
    )
    return lone.unionByName(whole).join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def encode_and_digest(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the documents to a fresh folder of the shared store and returns the digests read back from it."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    folder = f"{shared_folder(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, tokenizer_path, end_id)
    return digests(docs.sparkSession, folder)
