"""Benchmark decontamination: CGK random-walk embeddings, bit-sampling LSH over item-sized windows, exact edit counts.

A text is lower-cased (A-Z) and its white-space runs become one blank. An embedding walks over it: every step writes the
byte where it stands and moves on by one or stays, as a random function of the step and that byte says, so that a walk
falls back into step after an edit and edit distance becomes Hamming distance. A table samples some steps of the walk;
what they wrote is the key. TABLES embeddings with samples of their own walk from every byte of the documents and of the
items, so neither words nor their places matter.

A walk over a whole item drifts apart at the edit rates that max_rate allows, so walks are short and a window as long as
an item (and its edits) is found by how many of them collide in it: a collision lies on a diagonal, its place in the
document less its place in the item, and an item with at most k edits keeps its true ones on k + 1 neighbouring
diagonals, hence within two neighbouring bins of that width. Windows with enough collisions are candidates: the least
number of edits between the item and any part of the document there is counted exactly. A hit needs at most
max_rate * length edits; at_byte is where such a best part begins.

How many collisions are enough follows from the target recall: random strings of the item's length, given max_rate *
length random edits, are walked; the count that all but a share MARGIN of what the target lets miss reach is asked for,
with the longest walk that leaves ENOUGH. An exact copy keeps all its walks and is always found. Two sieves that
lose nothing save work: bins that share a counter, before collisions are sorted, and an item's triples, before edits are counted.

Items of fewer than SHORTEST normalised bytes say little once edited: they match as exact copies alone, and not inside a
longer ASCII word or number. Empty items and null texts match nothing; repeated items and rows each give their own hits,
and of equally good parts of a document the first counts. Very long texts are walked whole, a step of their own. Columns
other than doc_id and text (item_id and text) are not read by contaminated() and pass through decontaminate(). An empty
table on either side gives no hits.

One pass over the documents serves PASS bytes of items (what every task holds of the benchmark); a larger benchmark takes
more passes, never fewer items. Within a pass the items are indexed in blocks of BLOCK bytes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, lower_ascii, steps, white_space

PASS, BLOCK, SHORTEST, SEED = 64 << 20, 1 << 20, 20, 20240607
#: Embeddings, the chance that a step moves on, and the share of steps that a table samples.
TABLES, MOVE, SAMPLED = 2, 0.9, 0.85
#: Steps of a walk, and the collisions that a length must leave at max_rate edits to be taken; the last one is taken anyway.
LENGTHS, ENOUGH = (18, 16, 14, 13, 12, 11, 10, 9, 8, 7, 6), 12
#: The part of the misses that the target recall allows for which the count of collisions may be the cause.
MARGIN, TRIAL_BYTES = 0.2, 40_000
#: Lengths of items are treated alike in classes that grow by this factor.
CLASS = 1.06
#: Collisions that one step expands at a time; bytes that walks advance over together.
SLAB, STRIP = 2_000_000, 1 << 15


class Walks:
    """One embedding and its sample of steps: keys of the walks from every place of normalised texts.

    The walk of t + 1 steps from a place is its first step and the walk of t steps from there or from the next place, so
    all walks of all lengths come from one sweep for each step. A zero byte never moves on: no walk leaves its text.
    """

    def __init__(self, table: int):
        rng = np.random.default_rng((SEED, table))
        most = max(LENGTHS)
        moves = rng.random((256, most)) < MOVE
        moves[0] = False
        bit = np.arange(most, dtype=np.uint32)
        self.moves = (moves.astype(np.uint32) << bit).sum(axis=1, dtype=np.uint32)
        self.turned = (moves.astype(np.uint32) << (np.uint32(31) - bit)).sum(axis=1, dtype=np.uint32)
        self.sampled = rng.random(most) < SAMPLED
        self.sampled[:3] = True

    def keys(self, put: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
        most = max(lengths)
        out = {n: np.empty(len(put), np.uint32) for n in lengths}
        padded = np.concatenate([put, np.zeros(most + 1, np.uint8)])
        for lo in range(0, len(put), STRIP):
            here = padded[lo : lo + STRIP + most]
            moves, byte = self.turned.take(here), here.astype(np.uint32) + np.uint32(1)
            n, size = min(STRIP, len(put) - lo), len(here)
            key, new, goes = np.zeros(size + 1, np.uint32), np.zeros(size + 1, np.uint32), np.empty(size, np.uint32)
            for t in range(most):
                # all ones where the walk goes on (the step's bit is the sign): the key there is the next place's
                np.right_shift(moves.view(np.int32), np.int32(31), out=goes.view(np.int32))
                np.left_shift(moves, np.uint32(1), out=moves)
                here = new[:-1]
                np.bitwise_xor(key[:-1], key[1:], out=here)
                np.bitwise_and(here, goes, out=here)
                np.bitwise_xor(here, key[:-1], out=here)
                if self.sampled[t]:
                    here *= np.uint32(0x9E3779B1)
                    here += byte
                key, new = new, key
                if t + 1 in out:
                    out[t + 1][lo : lo + n] = key[:n]
        return out

    def inside(self, put: np.ndarray, length: int) -> np.ndarray:
        """The places from which a walk of that length writes no zero byte."""
        at = np.arange(len(put))
        for t in range(length - 1, 0, -1):
            at = np.minimum(at + ((self.moves[put[at]] >> np.uint32(t)) & 1), len(put) - 1)
        return put[at] != 0


#: Built once per process. (A cache that wraps the function would be pickled by name, which workers without the package cannot look up.)
_WALKS: list[Walks] = []


def embeddings() -> list[Walks]:
    if not _WALKS:
        _WALKS.extend(Walks(t) for t in range(TABLES))
    return _WALKS


def edited(rng: np.random.Generator, length: int, edits: int, trials: int) -> tuple[np.ndarray, np.ndarray]:
    """Random strings, a zero after each, and the same with random edits at different places; both end to end."""
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    plain = rng.choice(letters, (trials, length))
    kind = np.zeros((trials, length), np.int8)
    at = np.argsort(rng.random((trials, length)), axis=1)[:, :edits]
    np.put_along_axis(kind, at, rng.integers(1, 4, at.shape, np.int8), axis=1)  # 1 lost, 2 changed, 3 one more before it
    new = rng.choice(letters, (trials, length))
    two = np.stack([new, np.where(kind == 2, new, plain)], axis=2)
    stay = np.stack([kind == 3, kind != 1], axis=2)
    end = np.zeros((trials, 1), np.uint8)
    both = np.concatenate([two.reshape(trials, -1), end], axis=1)[np.concatenate([stay.reshape(trials, -1), end == 0], axis=1)]
    return np.concatenate([plain, end], axis=1).ravel(), both


@lru_cache(4096)
def collisions_left(length: int, edits: int, miss: float) -> tuple[int, int]:
    """Walk length, and the count of collisions that `edits` random edits of an item leave with probability 1 - miss."""
    trials = int(np.clip(TRIAL_BYTES // length, 200, 1000))
    plain, both = edited(np.random.default_rng((SEED, length)), length, edits, trials)
    # the string that each byte is in
    own, of = (np.cumsum(x == 0) - (x == 0) for x in (plain, both))
    keys = [(w, w.keys(plain, list(LENGTHS)), w.keys(both, list(LENGTHS))) for w in embeddings()]

    def least(n: int) -> int:
        left = np.zeros(trials, np.int64)
        for w, a, b in keys:
            seen = np.isin((own << 32) | a[n], (of << 32) | b[n]) & w.inside(plain, n)
            left += np.bincount(own[seen], minlength=trials)
        return int(np.sort(left)[int(miss * trials)])

    # longer walks collide less: the first length with enough
    n = LENGTHS[min(bisect_left(LENGTHS, ENOUGH, key=least), len(LENGTHS) - 1)]
    return n, max(1, least(n))


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts lower-cased, white-space runs as one blank, a zero byte after each; offsets."""
    low = lower_ascii()
    low[0] = 1
    ws = white_space()
    low[ws] = 32
    n = len(offsets) - 1
    put = np.insert(low[data], offsets[1:], 0)  # a zero after each text ends every seed
    off = offsets + np.arange(n + 1)
    blank = put == 32
    before = np.ones(len(put), bool)
    before[1:] = blank[:-1] | (put[:-1] == 0)
    stay = ~(blank & before)
    place = np.concatenate(([0], np.cumsum(stay)))
    return put[stay], place[off]


class Keys:
    """Where items hold some keys: sorted keys with tables of what their leading bits can be and where those begin."""

    def __init__(self, key: np.ndarray, item: np.ndarray, place: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.keys, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        bits = len(self.keys).bit_length()
        self.shift, self.far = np.uint32(32 - min(22, bits + 5)), np.uint32(32 - min(24, bits))
        self.seen = np.zeros(1 << (32 - int(self.shift)), bool)
        self.seen[self.keys >> self.shift] = True
        self.begin = np.searchsorted(self.keys >> self.far, np.arange((1 << (32 - int(self.far))) + 1))
        self.most = int(np.diff(self.begin).max())

    def maybe(self, key: np.ndarray) -> np.ndarray:
        """The places of all held keys in an array, and some more."""
        near = np.empty(len(key), bool)
        for lo in range(0, len(key), STRIP):
            self.seen.take((key[lo : lo + STRIP] >> self.shift).astype(np.intp), out=near[lo : lo + STRIP], mode="clip")
        return np.flatnonzero(near)

    def hits(self, at: np.ndarray, key: np.ndarray):
        """For keys and their places in the texts; yields arrays: place in the texts, item, place in the item."""
        slot = (key >> self.far).astype(np.intp)
        k, end = self.begin[slot], self.begin[slot + 1]
        for _ in range(self.most):
            less = (k < end) & (self.keys.take(k, mode="clip") < key)
            if not less.any():
                break
            k += less
        ok = np.flatnonzero((k < end) & (self.keys.take(k, mode="clip") == key))
        at, k = at[ok], k[ok]
        count, first = self.count[k], self.first[k]
        total, lo = np.cumsum(count), 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLAB, "right")))
            n = count[lo:hi]
            run = np.repeat(first[lo:hi] - np.cumsum(n) + n, n)
            run += np.arange(len(run))
            yield np.repeat(at[lo:hi], n), self.item[run], self.place[run]
            lo = hi


def starts(put: np.ndarray, n: int) -> np.ndarray:
    """The first n (at most 4) bytes from every place on, mixed into a key."""
    four = np.ndarray(len(put), "<u4", np.concatenate([put, np.zeros(4, np.uint8)]), strides=(1,)) & np.uint32((1 << (8 * n)) - 1)
    return (four ^ (four >> np.uint32(15))) * np.uint32(0x9E3779B1)


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(count, first)


def _crowded(key: np.ndarray, least: int) -> np.ndarray:
    """The keys without most of those that meet fewer than `least` others in their bin and a neighbouring one.

    Counted in a small table that bins may share, neighbours side by side, so that no key with enough is lost."""
    bits = max(10, len(key).bit_length() - 1)
    slot = (key >> 32) * 0x9E3779B1 >> 7
    slot += key
    slot &= (1 << bits) - 1
    count = np.bincount(slot, minlength=1 << bits)
    both = count + np.roll(count, -1) >= least
    return key[(both | np.roll(both, 1))[slot]]


def may_hold(item: bytes, piece: bytes, room: int) -> bool:
    """False only if no part of the piece is within that many edits: an edit changes at most three of the item's triples."""
    here = Counter(zip(piece, piece[1:], piece[2:]))
    own = Counter(zip(item, item[1:], item[2:]))
    return sum(min(n, here[t]) for t, n in own.items() if t in here) >= len(item) - 2 - 3 * room


def item_texts(items: list[tuple[int, str]]) -> list[bytes]:
    put, off = normalised(*flat(pa.array([t for _, t in items], pa.string())))
    return [put[off[k] : off[k + 1] - 1].tobytes().rstrip() for k in range(len(items))]


def walk_rules(items: list[tuple[int, str]], max_rate: float, recall: float) -> dict[int, tuple[int, int]]:
    """collisions_left() by the length of an item, computed for the least length of its class and no fewer edits."""
    out = {}
    for n in sorted({len(t) for t in item_texts(items)}):
        if n >= SHORTEST:
            low = max(SHORTEST, int(CLASS ** int(np.log(n) / np.log(CLASS) + 1e-9)))
            out[n] = collisions_left(min(low, n), int(np.ceil(max_rate * low)), (1 - recall) * MARGIN)
    return out


class ItemIndex:
    """The keys of one block of items."""

    def __init__(self, items: list[tuple[int, str]], rules: dict[int, tuple[int, int]], max_rate: float):
        """rules: walk length and least count of collisions by the length of an item."""
        self.ids = [i for i, _ in items]
        self.text = item_texts(items)
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.room = np.array([int(max_rate * len(t)) for t in self.text], np.int64)
        self.part = 1.0 / (self.room + 1)
        self.least = np.ones(len(items), np.int64)
        by_length: dict[int, list[int]] = {}
        short: dict[int, list[int]] = {}
        for k, t in enumerate(self.text):
            if len(t) >= SHORTEST:
                n, self.least[k] = rules[len(t)]
                by_length.setdefault(n, []).append(k)
            elif t:
                short.setdefault(min(len(t), 4), []).append(k)
        self.lengths = sorted(by_length)
        self.walks = {n: [self._walked(w, n, some) for w in embeddings()] for n, some in by_length.items()}
        self.short = {n: Keys(np.concatenate([starts(np.frombuffer(self.text[k], np.uint8), n)[:1] for k in some]), np.array(some), np.zeros(len(some), np.int64)) for n, some in short.items()}
        self.padded = np.zeros((len(items), SHORTEST), np.uint8)
        for k in (k for some in short.values() for k in some):
            self.padded[k, : len(self.text[k])] = np.frombuffer(self.text[k], np.uint8)

    def _walked(self, walks: Walks, length: int, some: list[int]) -> Keys:
        put = np.frombuffer(b"".join(self.text[k] + b"\0" for k in some), np.uint8)
        size = self.size[some] + 1
        at = np.flatnonzero(walks.inside(put, length))
        own = np.searchsorted(np.cumsum(size), at, "right")
        return Keys(walks.keys(put, [length])[length][at], np.array(some)[own], at - (np.cumsum(size) - size)[own])

    def hits(self, col: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item's place, edits, byte offset in the normalised text): the best of each row and item."""
        return [hit for _, hit in best_hits([self], col)]

    def found(self, put, off, rows, met):
        """(row, item, edits, byte offset), some pairs more than once; rows: that of each byte; met: what best_hits() gathers."""
        return [*self._copies(put, off), *self._edited(put, off, rows, met)]

    def _copies(self, put, off):
        """Exact copies of short items that no ASCII letter or digit prolongs."""
        if not self.short:
            return
        inside = np.zeros(256, bool)
        inside[[*range(48, 58), *range(97, 123)]] = True
        held = np.concatenate([[0], put, np.zeros(SHORTEST + 1, np.uint8)]).astype(np.uint8)
        for first, keys in self.short.items():
            key = starts(put, first)
            at = keys.maybe(key)
            for at, item, _ in keys.hits(at, key[at]):
                n = self.size[item]
                ok = ~(inside[held[at]] & inside[held[at + 1]]) & ~(inside[held[at + n]] & inside[held[at + n + 1]])
                at, item, n = at[ok], item[ok], n[ok]
                same = np.ones(len(at), bool)
                for j in range(SHORTEST):
                    same &= (j >= n) | (held[at + 1 + j] == self.padded[item, j])
                at, item = at[same], item[same]
                row = np.searchsorted(off, at, "right") - 1
                key, first = np.unique(row * len(self.ids) + item, return_index=True)
                for k, f in zip(key.tolist(), first.tolist()):
                    yield k // len(self.ids), k % len(self.ids), 0, int(at[f] - off[row[f]])

    def _bins(self, off, rows, met):
        """(bin, 1) of every collision: row, item and diagonal; beyond SLAB of them, some already as (bin, sum)."""
        items, shift, size = len(self.ids), int(self.size.max(initial=0)), 0
        keys, counts = [], []
        for held, near, key in met:
            for at, item, place in held.hits(near, key):
                row = rows[at]
                # half a step from the bin's edges, so that the product is floored as the quotient is
                bins = ((at - off[row] + shift - place + 0.5) * self.part[item]).astype(np.int64)
                bins += (row * items + item) << 32
                keys.append(bins)
                size += len(bins)
                if size > SLAB:
                    old = [*counts, *(np.ones(len(k), np.int64) for k in keys[len(counts) :])]
                    key, count = _summed(np.concatenate(keys), np.concatenate(old))
                    keys, counts, size = [key], [count], 0
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        return key, np.concatenate([*counts, np.ones(len(key) - sum(map(len, counts)), np.int64)]) if counts else None

    def _edited(self, put, off, rows, met):
        """Parts of the texts that are within the items' edits."""
        items, shift = len(self.ids), int(self.size.max(initial=0))
        key, count = self._bins(off, rows, met)
        if count is None:
            key = _crowded(key, int(self.least[self.size >= SHORTEST].min(initial=1 << 40)))
            count = np.ones(len(key), np.int64)
        if not len(key):
            return
        key, count = _summed(key, count)
        both = count.copy()
        both[:-1] += np.where(key[1:] == key[:-1] + 1, count[1:], 0)
        key = key[both >= self.least[(key >> 32) % items]]
        if not len(key):
            return
        cut = np.flatnonzero(np.diff(key) > 1)  # neighbouring bins are verified in one go
        for a, b in zip(key[np.append(0, cut + 1)].tolist(), key[np.append(cut, len(key) - 1)].tolist()):
            row, it = divmod(a >> 32, items)
            text, room = self.text[it], int(self.room[it])
            begin = (a & 0xFFFFFFFF) * (room + 1) - shift - room
            end = ((b & 0xFFFFFFFF) + 2) * (room + 1) - shift + len(text) + room
            begin, end = max(0, begin), min(max(0, end), int(off[row + 1] - off[row] - 1))
            piece = put[off[row] + begin : off[row] + end].tobytes()
            at = piece.find(text)
            if at >= 0:
                yield row, it, 0, begin + at
                continue
            if not may_hold(text, piece, room):
                continue
            edits, stop = best_part(text, piece, room)
            if edits <= room:
                back = piece[max(0, stop - len(text) - room) : stop]
                yield row, it, edits, begin + stop - best_part(text[::-1], back[::-1])[1]


def best_hits(indexes: list[ItemIndex], col: pa.Array) -> list[tuple[int, tuple[int, int, int, int]]]:
    """(place of the index, hit) for the best hit of each row and item, by index, row and item."""
    best: dict[tuple[int, int, int], tuple[int, int]] = {}
    data, offsets = flat(col)
    lengths = sorted({n for index in indexes for n in index.lengths})
    for lo, hi in steps(offsets):
        part = offsets[lo : hi + 1]
        put, off = normalised(data[part[0] : part[-1]], part - part[0])
        met = [[] for _ in indexes]  # of each index, by embedding and length: its keys, places in the texts that may hold some, and the keys there
        for e, walks in enumerate(embeddings() if lengths else ()):
            for n, key in walks.keys(put, lengths).items():
                for index, some in zip(indexes, met):
                    if n in index.walks:
                        near = index.walks[n][e].maybe(key)
                        some.append((index.walks[n][e], near, key[near]))
        rows = np.repeat(np.arange(hi - lo), np.diff(off))
        for nth, index in enumerate(indexes):
            for row, it, edits, begin in index.found(put, off, rows, met[nth]):
                if (edits, begin) < best.get((nth, lo + row, it), (1 << 60, 0)):
                    best[nth, lo + row, it] = (edits, begin)
    return [(nth, (r, i, e, p)) for (nth, r, i), (e, p) in sorted(best.items())]


def best_part(item: bytes, piece: bytes, room: int | None = None) -> tuple[int, int]:
    """The least number of edits between the item and any contiguous part of the piece, and where the first such part ends.

    room: more edits than these need not be exact, so that the count ends where what is left can't bring it down."""
    n = len(item)
    most = n + len(piece) if room is None else room + len(piece)
    if not n:
        return 0, 0
    where = [0] * 256
    for i, c in enumerate(item):
        where[c] |= 1 << i
    full, high = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    least, stop = score, 0
    for at, eq in enumerate(map(where.__getitem__, piece), 1):
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # the first row is free: a part may begin anywhere
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        if score < least:
            least, stop = score, at
        elif score + at > most:
            break
    return least, stop


def part_edits(item: bytes, piece: bytes) -> int:
    """The least number of edits between the item and any contiguous part of the piece (bit-parallel, exact)."""
    return best_part(item, piece)[0]


def _passes(benchmark: DataFrame, most: int):
    """The items in lists of at most `most` bytes (or one item), read one after the other."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).toLocalIterator():
        n = len(row[1].encode())
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    if held:
        yield held


def indexes_of(items: list[tuple[int, str]], rules: dict, max_rate: float, block: int) -> list[ItemIndex]:
    """The items' indexes, each of at most `block` bytes of text (or one item)."""
    out, held, size = [], [], 0
    for i, t in items:
        n = len(t.encode())
        if held and size + n > block:
            out.append(ItemIndex(held, rules, max_rate))
            held, size = [], 0
        held.append((i, t))
        size += n
    return [*out, ItemIndex(held, rules, max_rate)]


def _report(items, rules, max_rate, block):
    def run(batches):
        indexes = indexes_of(items, rules, max_rate, block)
        for batch in batches:
            found = best_hits(indexes, batch.column(1))
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[r].as_py() for _, (r, _, _, _) in found], pa.int64()),
                    pa.array([indexes[k].ids[i] for k, (_, i, _, _) in found], pa.int64()),
                    pa.array([e for _, (_, _, e, _) in found], pa.int32()),
                    pa.array([len(indexes[k].text[i]) for k, (_, i, _, _) in found], pa.int32()),
                    pa.array([p for _, (_, _, _, p) in found], pa.int64()),
                ],
                ["doc_id", "item_id", "edits", "item_bytes", "at_byte"],
            )

    return run


HITS = "doc_id long, item_id long, edits int, item_bytes int, at_byte long"


def contaminated(docs: DataFrame, benchmark: DataFrame, max_rate: float = 0.2, recall: float = 0.95, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs and item that it holds: doc_id, item_id, edits, item_bytes, at_byte."""
    out, slim = None, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for items in _passes(benchmark, PASS):
        got = slim.mapInArrow(_report(items, walk_rules(items, max_rate, recall), max_rate, block), HITS)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], HITS)


def _drop(items, rules, max_rate, block, place):
    def run(batches):
        indexes = indexes_of(items, rules, max_rate, block)
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            stay[[r for _, (r, _, _, _) in best_hits(indexes, batch.column(place))]] = False
            yield batch.filter(pa.array(stay))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_rate: float = 0.2, recall: float = 0.95, block: int = BLOCK) -> DataFrame:
    """docs without the rows that hold an item; rows are judged one by one, all columns stay."""
    out, names = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]), docs.columns  # any names may stand in docs
    for items in _passes(benchmark, PASS):
        out = out.mapInArrow(_drop(items, walk_rules(items, max_rate, recall), max_rate, block, names.index("text")), out.schema)
    return out.toDF(*names)
