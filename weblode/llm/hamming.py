"""64-bit fingerprints: XXH64 of byte spans, SimHash bits, Gray rank, and a Gray-order hierarchical index."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
# The primes of the public XXH64 specification.
_P1, _P2, _P3, _P4, _P5 = (
    _U(0x9E3779B185EBCA87),
    _U(0xC2B2AE3D27D4EB4F),
    _U(0x165667B19E3779F9),
    _U(0x85EBCA77C2B2AE63),
    _U(0x27D4EB2F165667C5),
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def xxh64_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte span (data padded by 8). Spans under 32 bytes, by far the most, are hashed as vectors."""
    view8 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    view4 = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    h = sizes.astype(np.uint64) + _U((seed + int(_P5)) & ((1 << 64) - 1))
    long = np.flatnonzero(sizes >= 32)
    for lane in range(3):
        at = np.flatnonzero(sizes >= 8 * (lane + 1))
        k = _rotl(view8[starts[at] + 8 * lane] * _P2, 31) * _P1
        h[at] = _rotl(h[at] ^ k, 27) * _P1 + _P4
    done = sizes & ~7
    at = np.flatnonzero(sizes & 4)
    k = view4[starts[at] + done[at]].astype(np.uint64) * _P1
    h[at] = _rotl(h[at] ^ k, 23) * _P2 + _P3
    done = sizes & ~3
    for one in range(3):
        at = np.flatnonzero((sizes & 3) > one)
        k = data[starts[at] + done[at] + one].astype(np.uint64) * _P5
        h[at] = _rotl(h[at] ^ k, 11) * _P1
    h ^= h >> _U(33)
    h *= _P2
    h ^= h >> _U(29)
    h *= _P3
    h ^= h >> _U(32)
    if len(long):
        raw = memoryview(data)
        h[long] = [xxhash.xxh64_intdigest(raw[s : s + n], seed) for s, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)]
    return h


def majority_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row of hashes (offsets `first`): the bits set in over half of them; an empty row gives zero."""
    n = len(first) - 1
    out = np.zeros(n, np.uint64)
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    votes = np.zeros((len(full), 64), np.int64)
    at, limit = 0, 1 << 18  # hashes unpacked at a time
    while at < len(full):
        to = at + 1
        while to < len(full) and first[full[to] + 1] - first[full[at]] <= limit:
            to += 1
        low, high = first[full[at]], first[full[to - 1] + 1]
        if to == at + 1 and high - low > limit:
            for s in range(low, high, limit):
                votes[at] += _unpack(hashes[s : min(s + limit, high)]).sum(axis=0, dtype=np.int64)
        else:
            votes[at:to] = np.add.reduceat(_unpack(hashes[low:high]), first[full[at:to]] - low, axis=0, dtype=np.int64)
        at = to
    wins = votes * 2 > counts[full][:, None]
    out[full] = np.packbits(wins, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _unpack(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each pattern in the binary-reflected Gray sequence: the prefix parity of its bits."""
    r = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        r ^= r >> _U(shift)
    return r


class GrayForest:
    """Hierarchical indexes over distinct fingerprints in Gray order, one tree for each key.

    Level 0 holds the fingerprints of every key sorted by Gray rank. A node of the next
    level covers up to `fan` neighbours and factors out the bit pattern they share: `mask`
    marks the bits on which all agree, `bits` their values. Levels are added until each
    key has one root.
    """

    def __init__(self, keys: np.ndarray, fingerprints: np.ndarray, fan: int = 8):
        self.order = np.lexsort((gray_rank(fingerprints), keys))
        bits, mask, own = fingerprints[self.order], np.full(len(keys), ~_U(0)), keys[self.order]
        low, high = np.arange(len(own)), np.arange(1, len(own) + 1)
        self.root = np.cumsum(np.r_[False, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
        self.levels = [(bits, mask, low, low, high)]  # pattern, first child, first and last leaf
        tree = self.root
        while len(tree) and len(tree) > tree[-1] + 1:
            start = np.searchsorted(tree, np.arange(tree[-1] + 1))
            place = np.arange(len(tree)) - start[tree]
            cuts = np.flatnonzero(place % fan == 0)
            ones = np.bitwise_and.reduceat(bits & mask, cuts)
            zeros = np.bitwise_and.reduceat(~bits & mask, cuts)
            ends = np.r_[cuts[1:], len(tree)]
            bits, mask, low, high, tree = ones, ones | zeros, low[cuts], high[ends - 1], tree[cuts]
            self.levels.append((bits, mask, cuts, low, high))

    def links(self, radius: int, frontier: int = 1 << 19):
        """Yields (leaf, low, high): leaves low .. high - 1 come after the leaf in its tree and lie within the radius.

        A search walks down from the key's root with the differences accumulated so far. Each
        node adds only those on bits that its parent left open; a node past the radius drops
        its whole group, one whose open bits cannot lift it past the radius is taken whole.
        """
        leaves = self.levels[0][0]
        for at in range(0, len(leaves), frontier >> 4):
            q = np.arange(at, min(at + (frontier >> 4), len(leaves)))
            todo = [(len(self.levels) - 1, q, self.root[q], np.zeros(len(q), np.uint64), np.zeros(len(q), np.int64))]
            while todo:
                level, q, node, seen, acc = todo.pop()
                if len(q) > frontier:
                    half = len(q) // 2
                    todo += [(level, q[half:], node[half:], seen[half:], acc[half:]), (level, q[:half], node[:half], seen[:half], acc[:half])]
                    continue
                bits, mask, child, low, high = self.levels[level]
                own = mask[node]
                acc = acc + np.bitwise_count((leaves[q] ^ bits[node]) & own & ~seen)
                live = (acc <= radius) & (high[node] > q + 1)
                whole = live & (acc + np.bitwise_count(~own) <= radius)
                if whole.any():
                    yield q[whole], np.maximum(low[node[whole]], q[whole] + 1), high[node[whole]]
                live &= ~whole
                if level and live.any():
                    q, node, acc, seen = q[live], node[live], acc[live], own[live]
                    size = np.r_[child[1:], len(self.levels[level - 1][0])][node] - child[node]
                    base = np.cumsum(size) - size
                    below = np.repeat(child[node] - base, size) + np.arange(int(size.sum()))
                    todo.append((level - 1, np.repeat(q, size), below, np.repeat(seen, size), np.repeat(acc, size)))


class Components:
    """Connected components of 0 .. n - 1 by hooking roots to smaller ones; whole batches of links at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            p = self.roots()
            x, y = p[a], p[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
