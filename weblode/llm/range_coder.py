"""Adaptive context-mixing range coder for token ids, many blocks in lockstep.

A block is coded on its own: all models start afresh, a header carries its length and
checksums. For each id the coder mixes three predictions of ids:

* order 2 and order 1: the id that last followed the two, or the one, ids before, each with a
  confidence of 0 (none yet) to 7;
* order 0: an adaptive distribution over the ids that the block has had, in the order of their
  first coming, with a share for ids that are new to it; those follow a fixed law that falls
  with the id, as public vocabularies number their tokens by rank.

The weights of the mixture are learned, for each pair of confidences and for whether both orders agree: how often
order 2 is right, and how often one of both is. The id is coded
as "what order 2 says", else "what order 1 says", else under order 0, all by one narrowing of a
64-bit range with 28-bit frequencies, and a second one for new ids; 32-bit words leave at the
top, a carry runs back into the words written. Blocks are lanes of numpy vectors: one step codes
the next id of each. Order 0's shares are refreshed in steps that grow with the block.

Tables have a row for each entry and a column for each lane: what all lanes use often lies together.
Steps work on all lanes and mask what does not apply, which costs less than picking lanes.

Encoder and decoder share the model's code, so they cannot drift apart.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np

#: Ids of one block, and blocks coded at once.
BLOCK_IDS = 2048
LANES = 3584
MAGIC = b"CMR4"
_HEADER = struct.Struct("<4sIIII")  # magic, ids, words, checksum of both and the words, checksum of the ids
_U = np.uint64
_WORD, _FLOOR = _U(32), _U(1 << 32)
_CONTEXTS = 1 << 10
_MIX1, _MIX2, _SHIFT = 0x9E3779B1, 0x85EBCA6B, 32 - 10
#: What a context without an entry says: no id, with confidence 0.
_NOTHING = 0xFFFFFFF8
_BOTH = 128  # pairs of confidences, apart and agreeing
#: A weight's most, of 65,536: it leaves shares for the orders below.
_FULL = 65_400
#: Bits of a narrowing, and of them of the mixture's shares.
_BITS, _MIXED = 28, 12
#: Shares of order 0 sum to this, and new ids never have less than the second.
_SHARES = 12
_TOTAL, _NEW = 1 << _SHARES, 12
_PART, _OWN = _BITS - _MIXED, _BITS - _MIXED - _SHARES
#: Shares are refreshed at these steps, then at every multiple of the last.
_EARLY = (8, 16, 32, 64, 128, 256, 512)
#: Bits of the law of new ids, and lanes that are transposed at once.
_LAW, _TILE = 22, 32


def _law() -> np.ndarray:
    """Where each id's part of a new id's range starts, of 2^22; ids are the likelier the lower they are."""
    weight = 1.0 / (np.arange(1 << 16) + 400.0)
    return np.concatenate(([0], np.cumsum(np.floor(weight / weight.sum() * ((1 << _LAW) - (1 << 16))).astype(np.int64) + 1)))


_FIRST = _law().astype(np.uint32)
_WIDTH = np.diff(_FIRST)
_LAST = int(_FIRST[-1])


@functools.cache
def _ids_by_law() -> np.ndarray:
    """The id of every point of the law."""
    return np.repeat(np.arange(1 << 16, dtype=np.uint16), _WIDTH)


class DamagedBlock(ValueError):
    """A block whose bytes do not decode to the ids that its checksums were taken of."""


class _Model:
    """Model state of all lanes; row 0 of paired arrays is order 2, row 1 is order 1."""

    def __init__(self, lanes: int):
        self.lanes, self.lane = lanes, np.arange(lanes)
        self.lane32 = self.lane.astype(np.uint32)
        two = np.arange(2, dtype=np.uint32)[:, None]
        self.base = self.lane32 + two * np.uint32(_CONTEXTS * lanes)
        self.follow = np.full(2 * _CONTEXTS * lanes, _NOTHING, np.uint32)  # id << 3 | confidence
        sure = np.arange(_BOTH)
        start = np.array([0, 9000, 22000, 34000, 44000, 52000, 58000, 62000])
        # Weights of order 2, and of either order, in 1 / 65,536; where both say the same they are one.
        own = start[(sure >> 3) & 7]
        either = own + np.where(sure < 64, start[sure & 7] * (_FULL - own) // (2 * _FULL), 0)
        self.weights = np.repeat(np.concatenate([own, either]).astype(np.int32), lanes)
        self.weight_base = self.lane32 + two * np.uint32(_BOTH * lanes)
        self.least = two.astype(np.int32) + np.int32(1)
        self.prev1, self.prev2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        # Order 0: a row an id by first coming, a column a lane; the row after a lane's last id is for new ids.
        self.known = np.zeros(lanes, np.uint32)
        self.ids, self.counts = np.zeros((256, lanes), np.uint16), np.zeros((256, lanes), np.uint16)
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []  # lanes and new ids, step by step
        self._share(np.zeros(lanes, np.int32))

    def _share(self, new: np.ndarray) -> None:
        """Shares by count, at least 1 for a known id, what is left for new ones."""
        self.spans, known = None, self.known.astype(np.int32)
        rows = int(known.max(initial=0))
        starts = np.zeros((rows + 2, self.lanes), np.int32)
        stops = starts[1:]
        stops[:rows] = self.counts[:rows]
        for row in range(1, rows):
            stops[row] += stops[row - 1]
        total = np.maximum(stops[max(rows - 1, 0)], 1)
        stops *= np.int32(_TOTAL) - new - known
        stops //= total
        stops += np.arange(1, rows + 2, dtype=np.int32)[:, None]
        np.putmask(stops, np.arange(rows + 1, dtype=np.int32)[:, None] >= known, np.int32(_TOTAL))
        widths = np.diff(starts, axis=0)
        spans = starts[:-1]
        spans <<= 15
        spans |= widths
        self.spans = spans.view(np.uint32).ravel()

    def refresh(self, step: int) -> bool:
        """Takes new ids in and shares order 0 out again, at some steps; both sides do so at the same ones."""
        if step not in _EARLY and (step == 0 or step % _EARLY[-1]):
            return False
        since = step - max((e for e in (0, *_EARLY) if e < step), default=0) if step <= _EARLY[-1] else _EARLY[-1]
        missed = np.zeros(self.lanes, np.int64)
        self.counts[-1] = 0
        if self.fresh:
            lane, ids = (np.concatenate(x) for x in zip(*self.fresh, strict=True))
            self.fresh = []
            missed = np.bincount(lane, minlength=self.lanes)
            # Lane and id, then when it came: sorted, each id's first coming leads its run.
            come = np.sort((lane << 16 | ids) << 32 | np.arange(len(ids)))
            lead = np.flatnonzero(np.diff(come >> 32, prepend=-1))
            times = np.diff(lead, append=len(come))
            order = np.argsort(come[lead] >> 48 << 32 | come[lead] & 0xFFFFFFFF)
            owner, own, times = come[lead][order] >> 48, come[lead][order] >> 32 & 0xFFFF, times[order]
            size = np.bincount(owner, minlength=self.lanes)
            row = self.known[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            self.known = (self.known + size).astype(np.uint32)
            rows = len(self.ids)
            while rows <= int(self.known.max()) + 1:
                rows *= 2
            if rows > len(self.ids):
                more = ((0, rows - len(self.ids)), (0, 0))
                self.ids, self.counts = np.pad(self.ids, more), np.pad(self.counts, more)
            self.ids[row, owner] = own
            self.counts[row, owner] = 2 * times
        # What new ids have been counted under is no id's yet.
        self.counts[self.known, self.lane] = 0
        most = np.maximum((_TOTAL - self.known.astype(np.int64)) // 2, _NEW)
        self._share(np.clip(_TOTAL * missed // since, _NEW, most).astype(np.int32))
        return True

    def predict(self, n: int) -> None:
        """Predictions of the first n lanes, and up to where of 4096 order 2 and either order reach."""
        h = np.empty((2, n), np.uint32)
        np.multiply(self.prev1[:n], _MIX1, out=h[1])
        np.multiply(self.prev2[:n], _MIX2, out=h[0])
        h[0] += h[1]
        h >>= _SHIFT
        h *= self.lanes
        h += self.base[:, :n]
        self.at = h.astype(np.intp)
        self.entry = self.follow.take(self.at, mode="wrap")
        self.sure, self.say = self.entry & 7, self.entry >> 3
        pair = self.sure[0] << 3
        pair += self.sure[1]
        pair += (self.say[0] == self.say[1]) * np.uint32(64)
        pair *= self.lanes
        self.slot = (self.weight_base[:, :n] + pair).astype(np.intp)
        self.weight = self.weights.take(self.slot, mode="wrap")
        upto = self.weight >> 4
        upto += self.least
        self.upto = upto.view(np.uint32)

    def parts(self, row: np.ndarray, hits: np.ndarray, base: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of what is coded, of 2^28: what a hit's order has, else the id's row under order 0."""
        self.cell = (row * np.uint32(self.lanes) + self.lane32[: len(row)]).astype(np.intp)
        span = self.spans.take(self.cell, mode="wrap")
        start = span >> 15
        start *= rest
        start += base
        span &= 0x7FFF
        span *= rest
        own = self.upto[0] << _PART
        np.putmask(start, hits[1], own)
        np.putmask(start, hits[0], np.uint32(0))
        np.putmask(span, hits[1], base - own)
        np.putmask(span, hits[0], own)
        return start, span

    def order0(self) -> tuple[np.ndarray, np.ndarray]:
        """Where order 0's part begins, and what one of its shares has, of 2^28."""
        either = self.upto[1]
        return either << _PART, (np.uint32(1 << _MIXED) - either) << _OWN

    def learn(self, n: int, ids: np.ndarray, hits: np.ndarray) -> None:
        """Takes the ids in; hits are "as order 2 says" and "as either order says"."""
        # Order 0 counts what it codes; hits go to the last row, which is no id's.
        np.putmask(self.cell, hits[1], self.counts.size - 1)
        counts = self.counts.reshape(-1)
        counts[self.cell] = counts.take(self.cell, mode="wrap") + 2
        step = hits * np.int32(_FULL)
        step -= self.weight
        step >>= 5
        step += self.weight
        self.weights[self.slot] = step
        entry = self.entry - 3
        fresh = ids << 3
        fresh |= 1
        np.copyto(entry, fresh, where=self.sure < 3)
        more = self.entry + 1
        np.minimum(more, self.entry | 7, out=more)
        np.putmask(entry, self.say == ids, more)
        self.follow[self.at] = entry
        self.prev2[:n] = self.prev1[:n]
        self.prev1[:n] = ids


def _by_step(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids step by step, and the row of each under order 0: how many others came first before it did."""
    lanes, steps = ids.shape
    out, rows = np.empty((steps, lanes), np.uint16), np.empty((steps, lanes), np.uint16)
    place = np.empty(_TILE << 16, np.int32)
    step, lane = np.arange(_TILE * steps, dtype=np.int32), np.arange(_TILE)[:, None] << 16
    for at in range(0, lanes, _TILE):
        some = ids[at : at + _TILE]
        key = (lane[: len(some)] | some).ravel()
        place[key[::-1]] = step[: len(key)][::-1]  # of several at one place the last stays
        first = place.take(key, mode="wrap").astype(np.intp)
        rank = np.cumsum((first == step[: len(key)]).reshape(some.shape), axis=1, dtype=np.uint16)
        out[:, at : at + _TILE] = some.T
        rows[:, at : at + _TILE] = rank.ravel().take(first, mode="wrap").reshape(some.shape).T - np.uint16(1)
    return out, rows


class _Writer:
    """The ends of all lanes' ranges, and the words that have left them: a row each time, a column a lane."""

    def __init__(self, lanes: int):
        self.low, self.width = np.zeros(lanes, np.uint64), np.full(lanes, ~_U(0))
        self.lanes, self.rows = lanes, 512
        self.out, self.end = np.zeros(lanes * self.rows, np.uint32), np.arange(lanes)

    def _carry(self, lane: np.ndarray) -> None:
        place = self.end[lane] - self.lanes
        while len(place):
            self.out[place] += np.uint32(1)
            place = place[self.out[place] == 0] - self.lanes

    def emit(self, lane: np.ndarray, low: np.ndarray) -> None:
        place = self.end.take(lane, mode="wrap")
        if len(place) and int(place.max()) >= len(self.out):
            self.out = np.concatenate([self.out, np.zeros_like(self.out)])
        self.out[place] = low >> _WORD
        self.end[lane] = place + self.lanes

    def narrow(self, lane: np.ndarray | slice, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        """Narrows the lanes' ranges to a part of 2^bits; a range is never below 2^32, so one word at most is settled."""
        low, left = self.low[lane], self.width[lane] >> _U(bits)
        after = start.astype(np.uint64)
        after *= left
        after += low
        index = None if isinstance(lane, slice) else lane
        over = np.flatnonzero(after < low)
        if len(over):
            self._carry(over if index is None else index[over])
        left *= size.astype(np.uint64)
        thin = np.flatnonzero(left < _FLOOR)
        if len(thin):
            top = after.take(thin, mode="wrap")
            self.emit(thin if index is None else index.take(thin, mode="wrap"), top)
            after[thin] = top << _WORD
            left[thin] = left.take(thin, mode="wrap") << _WORD
        self.low[lane], self.width[lane] = after, left

    def words(self) -> list[np.ndarray]:
        sizes = self.end // self.lanes
        out, done = self.out.reshape(-1, self.lanes)[: int(sizes.max(initial=0))], []
        for at in range(0, self.lanes, _TILE):
            some = np.ascontiguousarray(out[:, at : at + _TILE].T)
            done += [some[i, :n] for i, n in enumerate(sizes[at : at + _TILE].tolist())]
        return done


def _alive(sizes: np.ndarray) -> list[int]:
    """How many lanes have an id at each step."""
    return np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left").tolist()


def _encode_lanes(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Code words of each lane; sizes must not rise."""
    lanes = len(sizes)
    model, writer = _Model(lanes), _Writer(lanes)
    by_step, rows = _by_step(ids)
    hits = np.empty((2, lanes), bool)
    for t, n in enumerate(_alive(sizes)):
        model.refresh(t)
        model.predict(n)
        x = by_step[t, :n].astype(np.uint32)
        hit = hits[:, :n]
        np.equal(model.say, x, out=hit)
        hit[1] |= hit[0]
        row = np.minimum(rows[t, :n], model.known[:n])
        start, size = model.parts(row, hit, *model.order0())
        writer.narrow(slice(0, n), start, size, _BITS)
        new = np.flatnonzero((row == model.known[:n]) > hit[1])
        if len(new):
            fresh = x.take(new, mode="wrap").astype(np.intp)
            writer.narrow(new, _FIRST.take(fresh, mode="wrap"), _WIDTH.take(fresh, mode="wrap"), _LAW)
            model.fresh.append((new, fresh))
        model.learn(n, x, hit)
    every = np.arange(lanes)
    for i in range(2):
        writer.emit(every, writer.low << _U(32 * i))
    return writer.words()


class _Reader:
    """The code words of all lanes, and where in their ranges they point."""

    def __init__(self, words: list[np.ndarray]):
        self.lanes, rows = len(words), max(map(len, words)) + 4
        data = np.zeros((rows, self.lanes), np.uint32)
        for at in range(0, self.lanes, _TILE):
            some = np.zeros((min(_TILE, self.lanes - at), rows), np.uint32)
            for i, w in enumerate(words[at : at + _TILE]):
                some[i, : len(w)] = w
            data[:, at : at + _TILE] = some.T
        self.code = (data[0].astype(np.uint64) << _WORD) | data[1]
        self.data, self.at = data.ravel(), np.arange(self.lanes) + 2 * self.lanes
        self.width = np.full(self.lanes, ~_U(0))

    def point(self, lane: np.ndarray | slice, bits: int) -> np.ndarray:
        """Where the lanes point, of 2^bits."""
        self.unit = self.width[lane] >> _U(bits)
        return np.minimum(self.code[lane] // self.unit, _U((1 << bits) - 1)).astype(np.uint32)

    def narrow(self, lane: np.ndarray | slice, start: np.ndarray, size: np.ndarray) -> None:
        ahead = self.code[lane] - self.unit * start.astype(np.uint64)
        left = self.unit
        left *= size.astype(np.uint64)
        thin = np.flatnonzero(left < _FLOOR)
        if len(thin):
            own = thin if isinstance(lane, slice) else lane.take(thin, mode="wrap")
            place = self.at.take(own, mode="wrap")
            # Damaged code may ask for words after the last; its checksum tells.
            ahead[thin] = (ahead.take(thin, mode="wrap") << _WORD) | self.data.take(place, mode="clip")
            self.at[own] = place + self.lanes
            left[thin] = left.take(thin, mode="wrap") << _WORD
        self.code[lane], self.width[lane] = ahead, left


def _decode_lanes(words: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    lanes, steps = len(words), int(sizes.max(initial=0))
    model, reader = _Model(lanes), _Reader(words)
    ids = np.zeros((steps, lanes), np.uint16)
    hits = np.empty((2, lanes), bool)
    find, find_row = None, (model.lane << _SHARES).astype(np.uint32)
    for t, n in enumerate(_alive(sizes)):
        if model.refresh(t) or t == 0:
            find = None  # the old table goes before the new one comes
            widths = (model.spans & 0x7FFF).reshape(-1, lanes)
            find = np.repeat(np.tile(np.arange(len(widths), dtype=np.uint16), lanes), widths.T.ravel())
            del widths
            known_ids = model.ids.reshape(-1)
        model.predict(n)
        value = reader.point(slice(0, n), _BITS)
        hit = hits[:, :n]
        np.less(value >> _PART, model.upto, out=hit)
        base, rest = model.order0()
        inner = value - base  # of no meaning for hits, but kept in bounds
        inner //= rest
        np.minimum(inner, _TOTAL - 1, out=inner)
        inner += find_row[:n]
        row = find.take(inner.astype(np.intp), mode="wrap").astype(np.uint32)
        start, size = model.parts(row, hit, base, rest)
        reader.narrow(slice(0, n), start, size)
        x = known_ids.take(model.cell, mode="wrap").astype(np.uint32)
        np.putmask(x, hit[1], model.say[1])
        np.putmask(x, hit[0], model.say[0])
        new = np.flatnonzero((row == model.known[:n]) > hit[1])
        if len(new):
            fresh = _ids_by_law().take(np.minimum(reader.point(new, _LAW), _LAST - 1).astype(np.intp), mode="wrap").astype(np.intp)
            reader.narrow(new, _FIRST.take(fresh, mode="wrap"), _WIDTH.take(fresh, mode="wrap"))
            x[new] = fresh
            model.fresh.append((new, fresh))
        ids[t, :n] = x
        model.learn(n, x, hit)
    out = np.empty((lanes, steps), np.uint32)
    for at in range(0, lanes, _TILE):
        out[at : at + _TILE] = ids[:, at : at + _TILE].T
    return out


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids (below 65,536) as header and code; the order of the list is kept."""
    done: list[bytes | None] = [None] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        sizes = np.array([len(blocks[i]) for i in part])
        ids = np.zeros((len(part), int(sizes.max(initial=0))), np.uint16)
        for row, i in enumerate(part):
            if len(blocks[i]) and int(blocks[i].max()) >= 1 << 16:
                raise ValueError("ids must be below 65,536")
            ids[row, : len(blocks[i])] = blocks[i]
        for i, words in zip(part, _encode_lanes(ids, sizes), strict=True):
            raw, size = words.astype("<u4").tobytes(), len(blocks[i])
            own = zlib.crc32(blocks[i].astype("<u4"))
            done[i] = _HEADER.pack(MAGIC, size, len(words), zlib.crc32(raw, zlib.crc32(struct.pack("<II", size, own))), own) + raw
    return done


def decode_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises DamagedBlock where header, code or checksums disagree."""
    heads = []
    for p in payloads:
        if len(p) < _HEADER.size or p[:4] != MAGIC:
            raise DamagedBlock("not a block")
        _, size, n_words, check, own = _HEADER.unpack_from(p)
        if len(p) != _HEADER.size + 4 * n_words or zlib.crc32(memoryview(p)[_HEADER.size :], zlib.crc32(struct.pack("<II", size, own))) != check:
            raise DamagedBlock("not a whole block")
        heads.append((size, own))
    done: list[np.ndarray | None] = [None] * len(payloads)
    order = sorted(range(len(payloads)), key=lambda i: -heads[i][0])
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        sizes = np.array([heads[i][0] for i in part])
        ids = _decode_lanes([np.frombuffer(payloads[i], "<u4", offset=_HEADER.size) for i in part], sizes)
        for row, i in enumerate(part):
            own = ids[row, : sizes[row]]
            if zlib.crc32(own.astype("<u4")) != heads[i][1]:
                raise DamagedBlock("checksum differs")
            done[i] = own
    return done
