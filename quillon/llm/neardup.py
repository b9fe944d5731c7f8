"""Problem 4: near-duplicates with small edits, by a parity-sketch join."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, durable, mix
from .copies import Node, classes_of, record

#: Frequent words whose order is known on all workers; all other words count as rare.
HEAD = 4096
#: Words of the head that are spread over the parts by how often they come together, and sets at most that this is counted in.
SPREAD, _SAMPLE = 1024, 8192
#: Bits of the parity sketch: one word of 64 and one of 32. A set goes by its sketch.
_BITS = 96
#: Sums of two set sizes up to which each family (size band) of parts reaches; each next reaches 2.4 times as far.
_FIRST, _RATIO = 28, 2.4
#: Rows of one key compared at once; longer runs are cut into blocks and compared tile by tile.
RUN = 8192
#: Sets that may have a key by chance: a key takes words until not more are expected to (were the words independent).
CROWD = 128
#: Words of a key at most, and errors that a part may stand for.
_WORDS, _ERRORS = 4, 2
_CAP = (1 << 12) - 1
#: Bytes of a row and of the rows of a task of the join.
_ROW, _TASK = 20, 6 << 20
#: Slices of the keys of a task, compared one after the other.
_SLICES = 8

_HASHES = WordHashes()


def most_different(total: np.ndarray, least: float) -> np.ndarray:
    """The largest symmetric difference of two sets of ``total`` elements together whose Jaccard similarity is ``least``."""
    return np.floor((1 - least) / (1 + least) * np.asarray(total, np.float64) + 1e-9).astype(np.int64)


def families(size: int, least: float) -> Iterator[tuple[int, int, int]]:
    """(family, parts, errors to stand for) in which a set of this size can meet partners.

    A family is a size band: it holds the pairs whose sizes add up to at most
    its bound and more than the bound before. It has half as many parts as such
    a pair may have errors (elements of one set only).
    """
    low, top = size * (1 + least), size * (1 + 1 / least)
    bound, before, number = _FIRST, 0, 0
    while before < top:
        if bound >= low:
            yield number, max(1, -(-(int(most_different(bound, least)) + 1) // 2)), int(most_different(min(bound, int(top + 1e-9)), least))
        before, bound, number = bound, int(bound * _RATIO), number + 1


class Tokens:
    """Words as 64-bit hashes with their order (rare first), the part that each falls into and the share of the sets that have it."""

    def __init__(self, head: list[str], shares: list[float] | None = None, sets: int = 1, together: np.ndarray | None = None):
        """head: words, the most frequent first; shares: the share of the sets that each is in; sets: their number; together: how often two of the first words are in one set."""
        self.ranks_of = {w: i for i, w in enumerate(head)}
        rank = {xxhash.xxh3_64_intdigest(w): i for i, w in enumerate(head)}
        self.keys = np.array(sorted(rank), np.uint64)
        self.ranks = np.array([rank[k] for k in self.keys.tolist()], np.uint64)
        share = np.array(shares if shares is not None else [1.0] * len(head))
        self.shares = share[self.ranks.astype(np.int64)] if head else np.zeros(0)
        #: A word outside the head is in no more sets than the last word of the head.
        self.rare = float(share[-1]) if len(head) == HEAD else 1.0 / max(1, sets)
        self.crowd = CROWD / max(1, sets)
        self.together = np.zeros((0, 0), np.float32) if together is None else together
        self._spread: dict[int, np.ndarray] = {}

    def parts(self, deciding: np.ndarray, m: int) -> np.ndarray:
        """The part of m that each word falls into.

        Any function of the word will do. Words that often come together are
        kept apart, so that the parts of a set are of like size and few hold
        nothing but the frame of a sentence that very many sets have.
        """
        if m not in self._spread:
            where = np.arange(len(self.together))
            if m < len(where):
                cost = np.zeros((m, len(where)))
                for word, row in enumerate(self.together):
                    where[word] = cost[:, word].argmin()
                    cost[where[word]] += row
            self._spread[m] = where
        where = self._spread[m]
        part = (deciding % np.uint64(m)).astype(np.int64)
        spread = deciding < np.uint64(len(where))
        part[spread] = where[deciding[spread].astype(np.int64)]
        return part

    def order(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, what decides the part, share of the sets) of each hash."""
        if not len(self.keys):
            return h >> np.uint64(1), mix(h), np.full(len(h), self.rare)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = self.keys[at] == h
        order = np.where(known, np.uint64(1 << 63) + np.uint64(HEAD) - self.ranks[at], h >> np.uint64(1))
        return order, np.where(known, self.ranks[at], mix(h)), np.where(known, self.shares[at], self.rare)


def sketches(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parity sketch of each set: every element flips one bit of 96, so two sketches differ in no more bits than their sets in elements."""
    bit = mix(h ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(_BITS)
    one = np.uint64(1)
    first = np.where(bit < 64, one << (bit & np.uint64(63)), np.uint64(0))
    second = np.where(bit >= 64, one << (bit & np.uint64(31)), np.uint64(0))
    return np.bitwise_xor.reduceat(first, starts), np.bitwise_xor.reduceat(second, starts)


def allotted(count: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(errors that each part stands for, whether they suffice) of sets with ``count[s, i]`` elements in part i.

    A pair is found in part i if it differs there in no more elements than both
    sets allot to it and has two in common. So a part of n elements that stands
    for e errors takes up min(e + 1, n - 1) of the pair's errors at least, and
    a pair of ``errors`` in all is found if more than these are taken up. Each
    set allots what it needs by itself, in one fixed order of parts: of two
    sets the one that allots more has every row that the other counts on.
    """
    n, m = count.shape
    room = np.maximum(count - 1, 0)
    base = -(-(errors[:, None] + 1 - np.arange(m)) // m) - 1
    e = np.clip(base, -1, _ERRORS)
    enough = np.minimum(e + 1, room).sum(axis=1) > errors
    for level in range(_ERRORS + 1):  # raise part after part to this level while errors are left
        gain = np.minimum(np.maximum(e, level) + 1, room) - np.minimum(e + 1, room)
        missing = errors + 1 - np.minimum(e + 1, room).sum(axis=1)
        raised = (np.cumsum(gain, axis=1) - gain < missing[:, None]) & ~enough[:, None]
        e = np.where(raised, np.maximum(e, level), e)
        enough = np.minimum(e + 1, room).sum(axis=1) > errors
    return e, enough


def _keys_of_parts(count: np.ndarray, begin: np.ndarray, e: np.ndarray, h: np.ndarray, share: np.ndarray, salt: np.ndarray, crowd: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, key, level) of every part of every set: parities of the hashes of its first words, with up to e words left out.

    A slot is a part of a set; its words come rare first. The key of two parts
    is a function of the words that both have: the parity of the first two,
    or of so many more that not over CROWD sets are expected to have them, or
    of all there are. If the parts differ in x and y words, leaving out x of
    one and y of the other gives both that key, at levels x and y at most.
    """
    slots_out, keys, levels = [], [], []
    slots = np.arange(len(count))
    mark = np.uint64(0xC2B2AE3D27D4EB4F)
    for gone in range(_ERRORS + 1):
        for out in combinations(range(_WORDS + gone - 1), gone):
            last_out = out[-1] if out else -1
            left = [i for i in range(_WORDS + gone) if i not in out]
            live = slots[(e >= gone) & (count > last_out) & (count - gone >= 2)]
            key, product = np.zeros(len(live), np.uint64), np.ones(len(live))
            for t, place in enumerate(left[:_WORDS], 1):
                has = count[live] > place
                # all words that are left are used up: the key says so
                done = ~has
                if done.any():
                    slots_out.append(live[done])
                    keys.append(mix(key[done] + mark) ^ salt[live[done]])
                    levels.append(np.full(int(done.sum()), gone))
                live, key, product = live[has], key[has], product[has]
                word = begin[live] + place
                key, product = key ^ mix(h[word] ^ mark), product * share[word]
                enough = (np.full(len(live), True) if t == _WORDS else product <= crowd) if t >= 2 else np.zeros(len(live), bool)
                if place > last_out:  # else a word is left out behind the key: a row of a lower level says the same
                    slots_out.append(live[enough])
                    keys.append(mix(key[enough]) ^ salt[live[enough]])
                    levels.append(np.full(int(enough.sum()), gone))
                live, key, product = live[~enough], key[~enough], product[~enough]
    return np.concatenate(slots_out), np.concatenate(keys), np.concatenate(levels)


def anchor_rows(token_sets: list[list[str]], tokens: Tokens, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(key of 64 bits, rows of three words: level 2 | size 12 | errors 2; second sketch; first sketch) of some sets of distinct words."""
    token_sets = [s for s in token_sets if s]
    if not token_sets:
        return np.zeros(0, np.uint64), np.zeros((3, 0), np.uint64)
    sizes = np.array([len(s) for s in token_sets], np.int64)
    h = _HASHES.of([w for s in token_sets for w in s])
    starts = np.cumsum(sizes) - sizes
    s1, s2 = sketches(h, starts)
    order, deciding, share = tokens.order(h)
    whose = np.repeat(np.arange(len(sizes)), sizes)
    by_family: dict[int, tuple[dict[int, int], int]] = {}
    for size in np.unique(sizes).tolist():
        for number, parts, errors in families(size, least):
            by_family.setdefault(number, ({}, parts))[0][size] = errors
    whom, keys, levels, limits = [], [], [], []
    short = np.zeros(len(sizes), bool)
    for number, (of_size, m) in sorted(by_family.items()):
        chosen = np.flatnonzero(np.isin(sizes, list(of_size)))
        new = np.full(len(sizes), -1)
        new[chosen] = np.arange(len(chosen))
        tok = new[whose] >= 0
        w, part = new[whose[tok]], tokens.parts(deciding[tok], m)
        own = w * m + part
        sort = np.lexsort((order[tok], own))
        count = np.bincount(own, minlength=len(chosen) * m)
        errors = np.array([of_size[s] for s in sizes[chosen].tolist()])
        e, enough = allotted(count.reshape(-1, m), errors)
        e[~enough] = _ERRORS  # all there is, for partners that count on it
        short[chosen[~enough]] = True
        salt = np.tile(mix(np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number + 1)), len(chosen))
        slot, key, level = _keys_of_parts(count, np.cumsum(count) - count, e.ravel(), h[tok][sort], share[tok][sort], salt, tokens.crowd)
        whom.append(chosen[slot // m])
        keys.append(key)
        levels.append(level)
        limits.append(e.ravel()[slot])
    if short.any():  # sets too small to allot enough: two of them share one of their first words (prefix filter)
        tok = short[whose]
        sort = np.lexsort((order[tok], whose[tok]))
        w, hw = whose[tok][sort], h[tok][sort]
        place = np.arange(len(w)) - np.searchsorted(w, w)
        first = place <= sizes[w] - np.ceil(least * sizes[w] - 1e-9)
        whom.append(w[first])
        keys.append(mix(hw[first] + np.uint64(0x51ED270B)))
        levels.append(np.zeros(int(first.sum()), np.int64))
        limits.append(np.full(int(first.sum()), _ERRORS))
    at, key = np.concatenate(whom), np.concatenate(keys)
    first = np.concatenate(levels).astype(np.uint64) << _LEVEL | np.minimum(sizes[at], _CAP).astype(np.uint64) << _SIZE | np.concatenate(limits).astype(np.uint64)
    return key, np.stack([first, s2[at], s1[at]])


_LEVEL, _SIZE, _LOW = np.uint64(14), np.uint64(2), np.uint64(3)
#: Of a key 48 bits are in the row; the others are those of the slice it is in.
_KEY = np.uint64((1 << 48) - 1)


def _size(row: np.ndarray) -> np.ndarray:
    return (row >> _SIZE & np.uint64(_CAP)).astype(np.int64)


def _meet(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether rows x[:, i] and y[:, i] of one key may be of similar sets: size, level and sketch."""
    size_x, size_y = _size(x[0]), _size(y[0])
    level = (x[0] >> _LEVEL) + (y[0] >> _LEVEL)
    allowed = np.minimum(x[0] & _LOW, y[0] & _LOW)
    open_ended = (size_x == _CAP) | (size_y == _CAP)
    apart = np.bitwise_count(x[2] ^ y[2]).astype(np.int64) + np.bitwise_count(x[1] ^ y[1])
    other = (x[1] != y[1]) | (x[2] != y[2])
    return other & (level <= allowed) & (open_ended | ((np.minimum(size_x, size_y) >= least * np.maximum(size_x, size_y) - 1e-9) & (apart <= most_different(size_x + size_y, least))))


#: Runs of fewer rows are compared all at once, place by place; longer ones each as a matrix, so many rows and columns of it at a time.
_SHORT, _STRIP, _WIDE = 64, 64, 512
#: Bits up to which the first sketch by itself rules out nearly all; where more may differ, both are compared at once.
_TELLING = 14
#: Places of pairs that are gathered before they are looked at in full.
_GATHERED = 1 << 18


def _both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs of names: first and second sketch of either, the smaller name first."""
    turn = (x[2] > y[2]) | ((x[2] == y[2]) & (x[1] > y[1]))
    return np.stack([np.where(turn, y[2], x[2]), np.where(turn, y[1], x[1]), np.where(turn, x[2], y[2]), np.where(turn, x[1], y[1])])


def _near(x: np.ndarray, y: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows that are near by their sizes and sketches (each pair once if both are the same rows).

    Both are sorted by size and compared block by block, so that the sizes of
    two blocks give a narrow limit to the bits in which sketches may differ.
    """
    if not x.shape[1] or not y.shape[1]:
        return
    size_x, size_y = _size(x[0]), _size(y[0])
    first_x, first_y, second_x, second_y = x[2], y[2], x[1].astype(np.uint32), y[1].astype(np.uint32)
    for at in range(0, len(size_x), _STRIP):
        to = min(at + _STRIP, len(size_x))
        low_size, high_size = int(size_x[at]), int(size_x[to - 1])
        begin = max(at if same else 0, int(np.searchsorted(size_y, np.ceil(low_size * least - 1e-9))))
        end = len(size_y) if high_size == _CAP or size_y[-1] == _CAP else int(np.searchsorted(size_y, np.floor(high_size / least + 1e-9), side="right"))
        for low in range(begin, end, _WIDE):
            high = min(low + _WIDE, end)
            top = int(size_y[high - 1])
            d = _BITS if high_size == _CAP or top == _CAP else min(_BITS, int(most_different(high_size + top, least)))
            apart = np.bitwise_count(first_x[at:to, None] ^ first_y[None, low:high])
            if d > _TELLING:
                apart += np.bitwise_count(second_x[at:to, None] ^ second_y[None, low:high])
            places = np.flatnonzero(apart <= d)
            i, j = places // (high - low) + at, places % (high - low) + low
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def _crossed(x: np.ndarray, y: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) in the rows x and y of one key, both sorted by level and size: only levels that may meet are compared.

    Rows at levels k and l meet where both may stand for k + l errors.
    """

    def at(rows: np.ndarray, level: int, errors: int) -> np.ndarray:
        begin, end = np.searchsorted(rows[0], np.array([level, level + 1], np.uint64) << _LEVEL)
        return np.flatnonzero((rows[0, begin:end] & _LOW) >= errors) + begin

    for k in range(_ERRORS + 1):
        for m in range(k if same else 0, _ERRORS + 1 - k):
            i = at(x, k, k + m)
            j = i if same and k == m else at(y, m, k + m)
            for p, q in _near(x[:, i], y[:, j], least, same and k == m):
                yield i[p], j[q]


def _pairs(found: list[np.ndarray]) -> np.ndarray:
    both = np.concatenate([np.zeros((4, 0), np.uint64), *found], axis=1)
    both = both[:, np.lexsort(both)]
    once = np.ones(both.shape[1], bool)
    once[1:] = (both[:, 1:] != both[:, :-1]).any(axis=0)
    return both[:, once]


def _gathered(places: Iterator[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Pairs of names of the places that meet; looked at many at a time."""
    held, n = [], 0

    def settle() -> np.ndarray:
        i, j = (np.concatenate(c) for c in zip(*held))
        keep = _meet(x[:, i], y[:, j], least)
        return _both(x[:, i[keep]], y[:, j[keep]])

    for place in places:
        held.append(place)
        n += len(place[0])
        if n >= _GATHERED:
            yield settle()
            held, n = [], 0
    if held:
        yield settle()


def within(key: np.ndarray, rows: np.ndarray, least: float) -> np.ndarray:
    """Pairs of names (4 x n) among rows sorted by key, level and size."""
    first = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1)))
    length = np.diff(np.append(first, len(key)))
    long = zip(first[length >= _SHORT].tolist(), length[length >= _SHORT].tolist())
    found = list(_gathered(((a + i, a + j) for a, n in long for i, j in _crossed(rows[:, a : a + n], rows[:, a : a + n], least, True)), rows, rows, least))
    some = np.repeat((length > 1) & (length < _SHORT), length)
    short, key, step = rows[:, some], key[some], 1
    at = np.arange(short.shape[1])
    level, allowed = short[0] >> _LEVEL, short[0] & _LOW
    # a first limit for all: the largest difference that the set of the row may have
    limit = np.minimum(most_different(np.floor(_size(short[0]) * (1 + 1 / least)), least), 64).astype(np.uint8)
    limit[_size(short[0]) == _CAP] = 64
    while True:
        at = at[at + step < short.shape[1]]
        at = at[key[at + step] == key[at]]
        if not len(at):
            return _pairs(found)
        i = at[np.bitwise_count(short[2, at] ^ short[2, at + step]) <= limit[at]]
        i = i[level[i] + level[i + step] <= np.minimum(allowed[i], allowed[i + step])]
        if len(i):
            i = i[_meet(short[:, i], short[:, i + step], least)]
            found.append(_both(short[:, i], short[:, i + step]))
        step += 1


def between(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Pairs of names between two blocks of rows of one key."""
    return _pairs(list(_gathered(_crossed(x, y, least, False), x, y, least)))


def packed(key: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of 20 bytes: key 48 bits | level 2 | size 12 | errors 2, then the sketch."""
    out = np.empty((len(key), _ROW), np.uint8)
    out[:, :8] = (((key & _KEY) << np.uint64(16)) | rows[0]).astype("<u8")[:, None].view(np.uint8)
    out[:, 8:16] = rows[2].astype("<u8")[:, None].view(np.uint8)
    out[:, 16:] = rows[1].astype("<u4")[:, None].view(np.uint8)
    return out


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(key, rows) of packed rows, sorted by key, level and size."""
    a = np.frombuffer(raw, np.uint8).reshape(-1, _ROW)
    head = np.ascontiguousarray(a[:, :8]).view("<u8")[:, 0]
    order = np.argsort(head, kind="stable")
    head, a = head[order], a[order]
    rows = np.stack([head & np.uint64(0xFFFF), np.ascontiguousarray(a[:, 16:]).view("<u4")[:, 0].astype(np.uint64), np.ascontiguousarray(a[:, 8:16]).view("<u8")[:, 0]])
    return head >> np.uint64(16), rows


_MET = "a binary, b binary, slice int, key long, block int, rows binary"


def _names(first: np.ndarray, second: np.ndarray) -> pa.Array:
    raw = np.empty((len(first), 12), np.uint8)
    raw[:, :8], raw[:, 8:] = first.astype(">u8")[:, None].view(np.uint8), second.astype(">u4")[:, None].view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.arange(0, 12 * (len(first) + 1), 12, dtype=np.int32)), pa.py_buffer(raw)])


def _met(pairs: np.ndarray, blocks: list[tuple[int, int, int, bytes]] = ()) -> pa.RecordBatch:
    n, k = pairs.shape[1], len(blocks)
    cols = [pa.concat_arrays([_names(pairs[i], pairs[i + 1]), pa.nulls(k, pa.binary())]) for i in (0, 2)]
    for i, kind in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary())):
        cols.append(pa.concat_arrays([pa.nulls(n, kind), pa.array([b[i] for b in blocks], kind)]))
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", "slice", "key", "block", "rows"])


def _join(least: float, run: int, hold: int = 1 << 22):
    """Over packed rows sorted by slice: the pairs of runs of up to ``run`` rows; the rows of longer runs go through, in numbered blocks.

    At most ``hold`` rows of a slice are held, and those of keys that have not
    shown to be long; the rows of a long key go on as they come.
    """
    none = np.zeros((4, 0), np.uint64)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        long: dict[int, int] = {}  # key -> rows that have gone on
        size, now = 0, None

        def settle(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if not size:
                return
            key, rows = unpacked(b"".join(held))
            first = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1)))
            length = np.diff(np.append(first, len(key)))
            known = np.isin(key[first], np.array(list(long), np.uint64)) if long else np.zeros(len(first), bool)
            blocks = []
            for at, n in zip(first[known | (length > run)].tolist(), length[known | (length > run)].tolist()):
                k = int(key[at])
                while n:
                    gone = long.get(k, 0)
                    take = min(n, run - gone % run)
                    blocks.append((now, k, gone // run, packed(key[at : at + take], rows[:, at : at + take]).tobytes()))
                    long[k] = gone + take
                    at, n = at + take, n - take
            rest = np.repeat(~known & (length <= run), length)
            if final:
                yield _met(within(key[rest], rows[:, rest], least), blocks)
                held, size = [], 0
            else:
                yield _met(none, blocks)
                held = [packed(key[rest], rows[:, rest]).tobytes()]
                size = int(rest.sum())

        for batch in batches:
            for s, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if s != now:
                    yield from settle(True)
                    now, limit = s, hold
                    long.clear()
                held.append(raw)
                size += len(raw) // _ROW
                if size > limit:
                    yield from settle(False)
                    limit = max(hold, 2 * size)
        yield from settle(True)

    return go


def _tile(least: float):
    def go(table: pa.Table) -> pa.Table:
        side = np.array(table.column("block").to_pylist())
        rows = {b: unpacked(b"".join(r for r, s in zip(table.column("rows").to_pylist(), side.tolist()) if s == b)) for b in np.unique(side).tolist()}
        (key, one), *two = rows.values()
        pairs = between(one, two[0][1], least) if two else within(key, one, least)
        return pa.table({"a": _names(pairs[0], pairs[1]), "b": _names(pairs[2], pairs[3])})

    return go


def _some(texts: list[str], most: int = 4 << 20) -> Iterator[list[str]]:
    """The texts in lists of about ``most`` characters."""
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t)
        if held >= most:
            yield some
            some, held = [], 0
    if some:
        yield some


def _slices(shared, least: float, slices: int):
    """Packed anchor rows of sets, by slice of the key; a slice gets one row a batch."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Tokens = shared.value
        for batch in batches:
            for sets in _some(batch.column(0).to_pylist()):
                key, rows = anchor_rows([t.split("\n") for t in sets], tokens, least)
                where = ((key >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(key)
                raw, where = packed(key[order], rows[:, order]), where[order]
                cuts = np.flatnonzero(np.diff(where, prepend=-1))
                ends = np.append(cuts[1:], len(where)) * _ROW
                offsets = np.concatenate([cuts * _ROW, ends[-1:]]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
                yield pa.RecordBatch.from_arrays([pa.array(where[cuts].astype(np.int32)), blob], names=["slice", "rows"])

    return go


def candidate_pairs(anchors: DataFrame, tasks: int, least: float, run: int = RUN) -> DataFrame:
    """(a, b): names of sets that share a key and pass the sketch. anchors (slice, rows): packed rows, _SLICES slices a task."""
    ordered = anchors.repartitionById(tasks, F.col("slice") % tasks).sortWithinPartitions("slice")
    met = durable(ordered.mapInArrow(_join(least, run), _MET))
    pairs = met.where("a IS NOT NULL").select("a", "b")
    long = met.where("block IS NOT NULL").select("slice", "key", "block", "rows")
    if long.limit(1).count():
        blocks = long.groupBy("slice", "key").agg(F.max("block").alias("last"))
        tiles = F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda o: F.struct(F.least(o, F.col("block")).alias("p"), F.greatest(o, F.col("block")).alias("q"))))
        spread = long.join(blocks, ["slice", "key"]).select("slice", "key", tiles.alias("t"), "rows", "block").select("slice", "key", "t.p", "t.q", "rows", "block")
        pairs = pairs.unionByName(spread.groupBy("slice", "key", "p", "q").applyInArrow(_tile(least), "a binary, b binary"))
    return pairs.distinct()


def _line(tokens: set[str]) -> str:
    """A set of words as one text: in order, each on a line."""
    return "\n".join(sorted(tokens))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, version, text) to the digests of the text (its words in order, its record, its set of words), the sketch that the set goes by and its words, each on a line; null where a text has none."""
    for batch in batches:
        digests, sets, at = [], [], []
        for text in batch.column(2).to_pylist():
            seq = None if text is None else Node.leaf(text)
            tree = None if text is None else record(text)
            digests.append((seq and seq.digest, tree and tree.digest))
            at.append(len(sets) if seq and seq.form else None)
            if at[-1] is not None:
                sets.append(set(seq.form.split(" ")))
        seqs, recs = zip(*digests) if digests else ((), ())
        lines, names = list(map(_line, sets)), pa.array([], pa.binary())
        if sets:
            sizes = np.array([len(s) for s in sets])
            s1, s2 = sketches(_HASHES.of([w for s in sets for w in s]), np.cumsum(sizes) - sizes)
            names = _names(s1, s2)
        own = [c.take(pa.array(at, pa.int64())) for c in (pa.array(map(xxhash.xxh3_128_digest, lines), pa.binary()), names, pa.array(lines, pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(seqs, pa.binary()), pa.array(recs, pa.binary()), *own], names=[*batch.schema.names[:2], "seq", "rec", "words", "name", "set"])


def _head_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
        counts.clear()
        return out

    for batch in batches:
        for line in batch.column(0).to_pylist():
            counts.update(line.split("\n"))
        if len(counts) > 500_000:
            yield flush()
    yield flush()


def _ranked(shared):
    """(set) to the ranks of its words of the head and, as they are, its other words."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value.ranks_of
        for batch in batches:
            own = [[ranks[w] for w in line.split("\n") if w in ranks] for line in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int16()))], names=["ranks"])

    return go


def _together(sample: list[list[int]], shares: list[float]) -> np.ndarray:
    """How often two of the first words of the head are in one set: in a sample of sets; among words that the sample hardly has a hundredth of what chance makes decides."""
    has = np.zeros((len(sample), len(shares)), np.float32)
    for i, ranks in enumerate(sample):
        has[i, ranks] = 1
    return has.T @ has / max(1, len(sample)) + 0.01 * np.outer(shares, shares).astype(np.float32)


def _coded(shared):
    """(name, words, set) to (name, words, code): the number and the ranks of the words of the head, two bytes each, then the other words, each on a line."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value.ranks_of
        for batch in batches:
            codes = []
            for line in batch.column(2).to_pylist():
                every = line.split("\n")
                known = [ranks[w] for w in every if w in ranks]
                codes.append(np.array([len(known), *known], "<u2").tobytes() + "\n".join([w for w in every if w not in ranks]).encode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes, pa.binary())], names=["name", "words", "code"])

    return go


def _words_of(code: bytes) -> set:
    """The set of a code: ranks and words that are not of the head."""
    n = 2 + 2 * int.from_bytes(code[:2], "little")
    return set(np.frombuffer(code[2:n], "<u2").tolist()).union(code[n:].split(b"\n") if code[n:] else ())


def _similar(least: float):
    def go(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        """Pairs of names and the sets under these names: the pairs of sets that are similar, by their words."""
        sets: dict[bytes, list[tuple[bytes, set]]] = {}
        for name, key, code in zip(*(texts.column(c).to_pylist() for c in ("name", "words", "code"))):
            sets.setdefault(name, []).append((key, _words_of(code)))
        out = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            for ka, x in sets.get(a, ()):
                for kb, y in sets.get(b, ()):
                    if ka == kb or a == b and ka > kb:
                        continue
                    common = len(x & y)
                    if common >= least * (len(x) + len(y) - common) - 1e-9:
                        out.append((ka, kb, common / (len(x) + len(y) - common)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, [pa.binary(), pa.binary(), pa.float64()])], names=["a", "b", "similarity"])

    return go


#: Pairs of names verified in one group.
_VERIFIED = 4096


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) by the digests of sets (name, words, code), of the pairs (a, b) of names whose sets are similar.

    Pairs with near names in common go to one group, so that a set travels
    once a group and not once a pair; a name with very many partners is salted.
    """
    ends = pairs.select(F.col("a").alias("n"), F.least("a", "b").alias("o")).unionByName(pairs.select(F.col("b").alias("n"), F.least("a", "b").alias("o")))
    near = ends.groupBy("n").agg(F.min("o").alias("lead"), F.count("*").alias("deg"))
    led = pairs.join(near.withColumnRenamed("n", "a"), "a")
    groups = max(1, -(-pairs.count() // _VERIFIED))
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("deg") / _VERIFIED))
    grouped = led.select("a", "b", F.pmod(F.xxhash64("lead", salt), F.lit(groups)).alias("g"))
    need = grouped.select("g", F.explode(F.array("a", "b")).alias("name")).distinct()
    texts = sets.join(need, "name").select(F.col("g").alias("u"), "name", "words", "code")
    return grouped.groupBy("g").cogroup(texts.groupBy("u")).applyInArrow(_similar(least), "a binary, b binary, similarity double")


class NearDuplicates:
    """Near-duplicates of a table of texts.

    members: id, class_id (copies that differ in formatting only), words (the
    distinct set of words). similar: a, b, similarity by ``words``, one row for
    every two sets that have at least ``least`` of their union in common.
    """

    def __init__(self, items: DataFrame, key: str, text: str, least: float = 0.8, run: int = RUN, version: str | None = None):
        if not 0.5 <= least <= 1:
            raise ValueError("least must be between 0.5 and 1")
        own = items.where(F.col(key).isNotNull())
        keyed = own.select(F.col(key).cast("string").alias("id"), F.col(version).alias("version") if version else F.lit(0).alias("version"), F.col(text).alias("t"))
        kind = keyed.schema["version"].dataType.simpleString()
        read = durable(keyed.mapInArrow(_read, f"id string, version {kind}, seq binary, rec binary, words binary, name binary, set string"))
        # the digests of all rows are narrow: the latest version of an id is found among them, not among the texts
        digests = read.select("id", "version", "seq", "rec", "words")
        if version:
            newest = digests.groupBy("id").agg(F.max(F.struct("version", "seq", "rec", "words")).alias("m")).select("id", "m.seq", "m.rec", "m.words")
        else:
            newest = digests.select("id", "seq", "rec", "words").distinct()
        self.members = durable(classes_of(durable(newest.where("words IS NOT NULL")), "words"))
        # each distinct set of words; the copies end here
        sets = durable(read.where("words IS NOT NULL").groupBy("words").agg(F.first("name").alias("name"), F.first("set").alias("set")))
        discard(read)
        n = sets.count()
        counts = sets.select("set").mapInArrow(_head_counts, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
        head = counts.orderBy(F.col("c").desc(), "word").limit(HEAD).collect()
        context = own.sparkSession.sparkContext
        shares = [r["c"] / max(1, n) for r in head]
        tokens = Tokens([r["word"] for r in head], shares, n)
        sample = sets.where(F.pmod(F.xxhash64("words"), F.lit(max(1, -(-n // _SAMPLE)))) == 0).select("set").mapInArrow(_ranked(context.broadcast(tokens)), "ranks array<smallint>")
        first = sample.select(F.filter("ranks", lambda r: r < SPREAD).alias("ranks")).limit(2 * _SAMPLE)
        tokens.together = _together([r["ranks"] for r in first.collect()], shares[:SPREAD])
        shared = context.broadcast(tokens)  # HEAD words at most
        tasks = max(context.defaultParallelism, -(-n * 40 * _ROW // _TASK))
        anchors = sets.select("set").mapInArrow(_slices(shared, least, tasks * _SLICES), "slice int, rows binary")
        found = candidate_pairs(anchors, tasks, least, run)
        # different sets of one sketch are looked at as well
        twins = sets.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select(F.col("name").alias("a"), F.col("name").alias("b"))
        coded = sets.select("name", "words", "set").mapInArrow(_coded(shared), "name binary, words binary, code binary")
        self.similar = verified(durable(found.unionByName(twins)), coded, least)

    def _named(self, end: str) -> DataFrame:
        return self.members.select(F.col("words").alias(end), F.col("class_id").alias("c" + end)).distinct()

    def _linked(self, same: DataFrame | None = None) -> DataFrame:
        both = self.similar.join(self._named("a"), "a").join(self._named("b"), "b").select("ca", "cb", "similarity")
        both = (both if same is None else both.unionByName(same)).where("ca <> cb")
        return both.groupBy(F.least("ca", "cb").alias("class_a"), F.greatest("ca", "cb").alias("class_b")).agg(F.max("similarity").alias("similarity"))

    @property
    def links(self) -> DataFrame:
        """class_a < class_b, similarity: one row for every two classes with similar sets of words."""
        # classes with one set of words: texts that are reorderings of each other
        return self._linked(self._named("a").join(self._named("b"), F.col("a") == F.col("b")).select("ca", "cb", F.lit(1.0).alias("similarity")).where("ca < cb"))

    def degrees(self) -> DataFrame:
        """(c, links): the number of links of each class that has any."""
        own = self._named("a").groupBy("a").agg(F.count("*").alias("n"))
        same = self._named("a").join(own, "a").select(F.col("ca").alias("c"), (F.col("n") - 1).alias("k"))
        ends = self._linked().select(F.explode(F.array("class_a", "class_b")).alias("c")).groupBy("c").agg(F.count("*").alias("k"))
        return same.unionByName(ends).groupBy("c").agg(F.sum("k").alias("links")).where("links > 0")

    @property
    def stars(self) -> DataFrame:
        """As links, but classes of one set of words are linked with the least of them only: enough to find groups."""
        least = self._named("a").groupBy("a").agg(F.min("ca").alias("cb"))
        return self._linked(self._named("a").join(least, "a").select("ca", "cb", F.lit(1.0).alias("similarity")))


def near_duplicates(items: DataFrame, key: str, text: str, least: float = 0.8, run: int = RUN, version: str | None = None) -> NearDuplicates:
    """Texts whose sets of distinct words have at least ``least`` (0.5 or more) of their union in common.

    Every set goes by a 96-bit parity sketch: each word flips a bit, so two
    sketches differ in no more bits than the sets in words. No pair is lost: in
    each band of sizes the words fall into parts by their hash, half as many as
    a pair may have errors; by the pigeonhole principle the errors of some part
    are no more than were allotted to it (see allotted), and there the parities
    (XOR) of the rarest words that both parts keep are equal. Frequent words
    that often come together, as a sample shows, fall into unlike parts. Rows are joined
    on that key; pairs whose sketches differ in more bits than such sets may in
    words are dropped, the others are verified on the words themselves. Keys
    take more words as the collection grows, so that their runs stay short.

    Where ``version`` names a column, the row of the greatest version of a key
    counts (nulls are least; among equal ones the greatest digest). Texts that
    are copies but for formatting are one class and are not linked with each
    other; a set of words is sketched once, however many texts have it. Runs of
    more than ``run`` rows of one key are compared in tiles. Null keys or texts
    and texts without a word have no links; rows of one key with unlike texts
    (and no version) each count; an empty table gives none.
    """
    return NearDuplicates(items, key, text, least, run, version)


def memory_pairs(memories: DataFrame, least: float = 0.7) -> DataFrame:
    """(id_a, id_b): every two memories that are not copies but near-duplicates."""
    near = near_duplicates(memories, "id", "content", least, version="updated_at")
    one, two = near.members.select(F.col("id").alias("ia"), F.col("class_id").alias("class_a")), near.members.select(F.col("id").alias("ib"), F.col("class_id").alias("class_b"))
    pairs = near.links.join(one, "class_a").join(two, "class_b")
    return pairs.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def groups(near: NearDuplicates) -> DataFrame:
    """id, class_id, group_id (least class of those linked directly or through others), links (of its class); one row an id.

    Least labels are passed on along the links and then along the labels
    (pointer jumping), so the rounds grow with the logarithm of a chain.
    """
    links = durable(near.stars.select("class_a", "class_b"))
    degree = near.degrees()
    both = links.unionByName(links.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    label = durable(near.members.select(F.col("class_id").alias("c")).distinct().withColumn("l", F.col("c")))
    while True:
        around = both.join(label.withColumnRenamed("c", "class_b"), "class_b").groupBy(F.col("class_a").alias("c")).agg(F.min("l").alias("n"))
        step = label.join(around, "c", "left").select("c", "l", F.least("l", F.coalesce("n", "l")).alias("m"))
        jump = step.select(F.col("c").alias("m"), F.col("m").alias("further"))
        new = durable(step.join(jump, "m").select("c", "l", F.least("m", "further").alias("m")))
        if not new.where("m <> l").limit(1).count():
            break
        label = new.select("c", F.col("m").alias("l"))
    named = label.join(degree, "c", "left").select(F.col("c").alias("class_id"), F.col("l").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return near.members.select("id", "class_id").join(named, "class_id").select("id", F.hex("class_id").alias("class_id"), F.hex("group_id").alias("group_id"), "links")
