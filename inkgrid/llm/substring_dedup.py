"""Near-duplicate passages by compact windows.

A text is a sequence of word shingles.  Under a hash function every stretch of shingles
has the place of its least hash as its signature; the stretches that share a place c are
those within a compact window (l, c, r), a node of the Cartesian tree over the hashes.
Only windows that hold a whole passage matter, about 2 n / width of n shingles.  Equal
signatures under any of several hash functions bring windows together; their intervals
are laid over each other at c and verified: two passages are near-duplicates if the
Jaccard similarity of their shingles reaches ``similarity``, wherever in them these stand.

Windows that are equal throughout settle each other.  Of the others only what several
texts of a group hold can be common, so the rest of each window is blanked; windows that
are then alike have one form, and forms are compared, not windows.  A form is done as
soon as its span is as wide as its common shingles allow.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, announced, keyed_texts, map_arrow, materialize, repeated, slices
from .suffix_dedup import _slide

SHINGLE = 5
#: Words of a passage.
WORDS = 50
SIMILARITY = 0.8
#: Hash functions; one that a pair shares brings it to verification.
HASHES = 3
#: Passages of up to so many times the width are verified as a whole wherever c stands in
#: them; of longer ones the parts within that reach of c.
REACH = 1.5
#: Windows of a signature that are compared in one task.  In a larger group equal windows
#: are settled first; if more different ones remain, they are cut into blocks, and each
#: pair of blocks is compared in a task of its own.
GROUP = 1 << 14
#: Windows that a chunk tells of at a time.
TOLD = 200_000

_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93)


def shingle_hashes(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, shingles of each, words of each."""
    number: defaultdict = defaultdict(itertools.count().__next__)
    rows = []
    for text in texts:
        words = (text or "").encode().lower().split()
        rows.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    words = np.fromiter(map(len, rows), np.int64, len(rows))
    table = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    found = []
    for row in rows:
        n = len(row) - shingle + 1
        if n > 0:
            h = np.zeros(n, np.uint64)
            value = table[row]
            for k in range(shingle):
                h = (h ^ value[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            found.append(h)
    return np.concatenate([*found, np.empty(0, np.uint64)]), np.maximum(words - shingle + 1, 0), words


def _spread(places: list[int], width: int) -> list[int]:
    """Some of ``places``, first and last among them, such that no stretch of ``width``
    holds others only."""
    out = places[:1]
    for i in range(1, len(places)):
        if i + 1 == len(places) or places[i + 1] - out[-1] > width:
            out.append(places[i])
    return out


def cartesian_windows(values: list[int], places: list[int], begin: int, end: int, width: int) -> list[tuple[int, int, int]]:
    """(l, c, r), r inclusive, of windows of ``width`` or more, from all places that are least
    in a stretch of that width; others lie below them in the tree and change nothing.

    Places of one hash with nothing less between them are one node; a window is given for
    as many of them as it takes for every stretch to hold one.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list[int], int]] = []

    def done(mine: list[int], low: int, high: int) -> None:
        if high - low + 1 >= width:
            out.extend((low, c, high) for c in (mine if len(mine) == 1 else _spread(mine, width)))

    for v, c in zip(values, places, strict=True):
        low = begin
        while stack and stack[-1][0] > v:
            _, mine, first = stack.pop()
            done(mine, first, c - 1)
        if stack:
            if stack[-1][0] == v:
                stack[-1][1].append(c)
                continue
            low = stack[-1][1][-1] + 1
        stack.append((v, [c], low))
    for _, mine, first in reversed(stack):
        done(mine, first, end - 1)
    return out


def compact_windows(h: np.ndarray, size: np.ndarray, width: int, hashes: int) -> Iterator[np.ndarray]:
    """For each hash function rows (text, value as int64, c, l, r) of windows of ``width``
    shingles or more; c, l and r count from the text's first shingle."""
    ends = np.cumsum(size)
    begins = ends - size
    ok = size >= width
    if not ok.any():
        return
    for k in range(hashes):
        g = (h ^ np.uint64(_SEEDS[k])) * np.uint64(_SEEDS[(k + 1) % len(_SEEDS)] | 1)
        g ^= g >> np.uint64(32)
        g = g | np.uint64(1)
        low = _slide(g, width, np.minimum)
        for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
            low[max(0, b, e - width + 1) : e] = 0
        pad = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), width, np.maximum) == g)
        cuts = np.searchsorted(at, np.concatenate([begins, ends[-1:]]))
        values, places, rows = g[at].tolist(), at.tolist(), []
        for i in np.flatnonzero(ok).tolist():
            b, x, y = int(begins[i]), cuts[i], cuts[i + 1]
            rows += [(i, c, c - b, first - b, last - b) for first, c, last in cartesian_windows(values[x:y], places[x:y], b, int(ends[i]), width)]
        if rows:
            out = np.array(rows, np.int64)
            out[:, 1] = (g[out[:, 1]] * np.uint64(_SEEDS[k]) ^ np.uint64(k)).view(np.int64)
            yield out


def _windows(width: int, reach: int, shingle: int, hashes: int):
    """Rows of ``announced``; p packs c and how far the window goes to both sides."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[tuple[np.ndarray, ...]] = []

        def rows() -> dict:
            return announced(*(np.concatenate([*(x[k] for x in held), np.empty(0, np.int64)]) for k in range(3)), across=True)

        for batch in batches:
            for a in range(0, len(batch["t"]), 512):
                texts = batch["text"].slice(a, 512).to_pylist()
                t = batch["t"].slice(a, 512).to_numpy()
                for i, j in slices(texts, 1 << 20):
                    h, size, _ = shingle_hashes(texts[i:j], shingle)
                    for found in compact_windows(h, size, width, hashes):
                        c = found[:, 2]
                        left, right = np.minimum(c - found[:, 3], reach - 1), np.minimum(found[:, 4] - c, reach - 1)
                        held.append((found[:, 1], t[i:j][found[:, 0]], c << 24 | left << 12 | right))
                    if sum(len(x[0]) for x in held) >= TOLD:
                        yield rows()
                        held = []
        yield rows()

    return run


def _contexts(shingle: int):
    """The shingles of each window around c as four-byte hashes, and how many precede c."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for a in range(0, len(batch["t"]), 256):
                texts, at, keys = batch["text"].slice(a, 256).to_pylist(), batch["at"].slice(a, 256), batch["t"].slice(a, 256).to_numpy()
                counts = at.value_lengths().to_numpy()
                v, p = (at.flatten().field(k).to_numpy() for k in (0, 1))
                stops = np.cumsum(counts)
                for i, j in slices(texts, 1 << 19):
                    h, size, _ = shingle_hashes(texts[i:j], shingle)
                    short = (h >> np.uint64(24)).astype(np.uint32) | np.uint32(1)
                    mine = slice(int(stops[i] - counts[i]), int(stops[j - 1]))
                    c, left, right = p[mine] >> 24, p[mine] >> 12 & 0xFFF, p[mine] & 0xFFF
                    base = np.repeat(np.cumsum(size) - size, counts[i:j]) + c
                    raw, first, last = short.tobytes(), 4 * (base - left), 4 * (base + right + 1)
                    around = [raw[x:y] for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                    yield {"v": v[mine], "t": np.repeat(keys[i:j], counts[i:j]), "c": c.astype(np.int32), "m": left.astype(np.int32), "around": pa.array(around, pa.binary())}

    return run


def own_names(rows: np.ndarray) -> np.ndarray:
    """Rows in which shingles that repeat are told apart by how often they have occurred on
    the way from the middle, so that stretches over the middle match them one to one."""
    ordered = np.sort(rows, 1)
    twice = ((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] > 0)).any(1)
    if not twice.any():
        return rows
    rows = rows.copy()
    middle = rows.shape[1] // 2
    for i in np.flatnonzero(twice).tolist():
        row = rows[i].tolist()
        right, left = Counter(), Counter()
        for j in range(middle, len(row)):
            if v := row[j]:
                if k := right[v]:
                    rows[i, j] = (v + k * 0x9E3779B1) % (1 << 32) | 1
                right[v] += 1
        for j in range(middle - 1, -1, -1):
            if v := row[j]:
                if k := left[v] + (v in right):
                    rows[i, j] = (v + k * 0x85EBCA77) % (1 << 32) | 1
                left[v] += 1
    return rows


def _bound(flags: np.ndarray, there: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last shingle of stretches that may pass if flagged shingles are common."""
    sums = np.zeros((len(flags), flags.shape[1] + 1), np.int16)
    np.cumsum(flags, 1, out=sums[:, 1:])
    long = _longer(flags, there, sums, width, similarity)
    return _ends(long.any(2), long.any(1))


def _full(there: np.ndarray, width: int) -> np.ndarray:
    """Whether all ``width`` shingles from each of the places before the middle are there."""
    begins = _begins(there.shape[1], width)
    sums = np.zeros((len(there), there.shape[1] + 1), np.int16)
    np.cumsum(there, 1, out=sums[:, 1:])
    return sums[:, begins + width] - sums[:, begins] == width


def _begins(full: int, width: int) -> np.ndarray:
    """Where stretches of ``width`` over the middle begin."""
    return np.arange(full // 2 + 1 - width, full // 2 + 1)


def _ends(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first beginning (up to the middle) and the last end (from it on), or none."""
    n = begin.shape[1]
    first = np.where(begin.any(1), begin.argmax(1), 2 * n - 1)
    return first, np.where(end.any(1), 2 * n - 2 - end[:, ::-1].argmax(1), -1)


@cache
def _needed(reach: int, width: int, similarity: float) -> np.ndarray:
    """Common shingles that a stretch from a (up to the middle) to b (from it on) must
    have, if the other one is as long as it must be; more than there are if too short."""
    m = np.arange(2 * reach)
    size = np.arange(reach - 1, 2 * reach - 1)[None, :] - np.arange(reach)[:, None] + 1
    enough = (1 + similarity) * m >= similarity * (size[:, :, None] + np.maximum(m, width)) - 1e-9
    return np.where((size >= width) & enough.any(2), enough.argmax(2), 2 * reach).astype(np.int16)


def _longer(flags: np.ndarray, there: np.ndarray, sums: np.ndarray, width: int, similarity: float) -> np.ndarray:
    """Whether a..b has enough common shingles, and is ``width`` long or begins and ends
    in common ones."""
    reach = flags.shape[1] // 2 + 1
    enough = sums[:, None, reach:] - sums[:, :reach, None] >= _needed(reach, width, similarity)
    a = _begins(flags.shape[1], width)
    b = a + width - reach
    exact = enough[:, a, b] & _full(there, width)
    enough &= flags[:, :reach, None] & flags[:, None, reach - 1 :]
    enough[:, a, b] = exact
    return enough


def near(at: np.ndarray, x_there: np.ndarray, least: np.ndarray, most: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of windows laid over each other at c: first and last shingle of x in
    stretches over c that are near y; first > last if none.

    ``at`` tells for each shingle of x which one of y it is, or -1.  Stretches of x have
    ``width`` shingles, or more if they begin and end in common ones, from ``least`` to
    ``most``.  Each is held against the least stretch of y that goes over its c, is no
    shorter than ``width`` and has all shingles that both windows have from it, wherever
    they stand: their Jaccard similarity must reach ``similarity``.
    """
    n, full = at.shape
    middle, flags, i = full // 2, at >= 0, np.arange(full)
    # c is in every stretch, so what it holds of y is what its halves up to and from c hold
    low = np.where(flags, at, np.int16(middle))
    high = low.copy()
    for held, extreme in ((low, np.minimum), (high, np.maximum)):
        held[:, middle:] = extreme.accumulate(held[:, middle:], 1)
        held[:, middle::-1] = extreme.accumulate(held[:, middle::-1], 1)
    sums = np.zeros((n, full + 1), np.int16)
    np.cumsum(flags, 1, out=sums[:, 1:])
    factor = np.float32((1 + similarity) / similarity)

    def enough(begin: tuple, end: tuple) -> np.ndarray:
        """Of stretches whose ends' places, sums and ranges are given."""
        size = np.maximum(np.maximum(begin[3], end[3]) - np.minimum(begin[2], end[2]), np.int16(width - 1))
        size += end[0] - begin[0]
        return (end[1] - begin[1]) * factor >= size + np.float32(2 - 1e-3)

    rows, k = np.arange(n), _begins(full, width)
    at_end = k + width - 1
    ok = enough((k.astype(np.int16), sums[:, k], low[:, k], high[:, k]), (at_end.astype(np.int16), sums[:, at_end + 1], low[:, at_end], high[:, at_end])) & _full(x_there, width)
    # they begin where k says, and end width - 1 further on
    first = np.where(ok.any(1), k[ok.argmax(1)], full)
    last = np.where(ok.any(1), k[::-1][ok[:, ::-1].argmax(1)] + width - 1, -1)
    inside = flags & (i >= least[:, None]) & (i <= most[:, None])
    a = np.where(inside.any(1), inside.argmax(1), middle)
    b = np.where(inside.any(1), full - 1 - inside[:, ::-1].argmax(1), middle)
    long = (a <= middle) & (b >= middle) & (b - a + 1 > width)
    whole = long & enough((a.astype(np.int16), sums[rows, a], low[rows, a], high[rows, a]), (b.astype(np.int16), sums[rows, b + 1], low[rows, b], high[rows, b]))
    first, last = np.where(whole, np.minimum(first, a), first), np.where(whole, np.maximum(last, b), last)
    rest = np.flatnonzero(long & ~whole & ((a < first) | (b > last)) & ((sums[rows, b + 1] - sums[rows, a]) * factor >= 2 * width + 1 - 1e-3))
    for j in range(0, len(rest), PAIRS):
        mine = rest[j : j + PAIRS]
        place = np.broadcast_to(np.arange(full, dtype=np.int16), (len(mine), full))
        begins = (place[:, : middle + 1], sums[mine, : middle + 1], low[mine, : middle + 1], high[mine, : middle + 1])
        ends = (place[:, middle:], sums[mine, middle + 1 :], low[mine, middle:], high[mine, middle:])
        may_begin, may_end = inside[mine, : middle + 1], inside[mine, middle:]
        # y's stretch is at least width, and from the least place of the beginning to the
        # last of the end: both tell ends that no beginning suits, without trying pairs
        worth_begin, worth_end = ((x[1] * factor - x[0]).astype(np.float32) for x in (begins, ends))
        could_begin, could_end = may_begin & (place[:, : middle + 1] < first[mine, None]), may_end & (place[:, middle:] > last[mine, None])
        for begin, end, least_gap in ((worth_begin, worth_end, width + 1), (worth_begin - begins[2], worth_end - ends[3], 2)):
            could_begin &= begin <= np.where(may_end, end, -np.inf).max(1)[:, None] - np.float32(least_gap - 1e-2)
            could_end &= end >= np.where(may_begin, begin, np.inf).min(1)[:, None] + np.float32(least_gap - 1e-2)

        def tried(could: np.ndarray, one: tuple, others: tuple, may: np.ndarray, backward: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Rows and places of the outermost of ``could`` that any of the others suit."""
            live = np.flatnonzero(could.any(1))
            while len(live):
                at = could.shape[1] - 1 - could[live, ::-1].argmax(1) if backward else could[live].argmax(1)
                this, that = tuple(x[live, at, None] for x in one), tuple(x[live] for x in others)
                begin, end = (that, this) if backward else (this, that)
                found = (enough(begin, end) & may[live] & (end[0] - begin[0] >= width)).any(1)
                yield live[found], this[0][found, 0]
                could[live, at] = False
                live = live[~found]
                live = live[could[live].any(1)]

        for row, at in tried(could_begin, begins, ends, may_end, False):
            first[mine[row]] = at
        for row, at in tried(could_end, ends, begins, may_begin, True):
            last[mine[row]] = at
    return first, last


def _least(width: int, similarity: float) -> int:
    """Common shingles of two stretches of ``width`` that are similar enough."""
    return int(np.ceil(2 * width * similarity / (1 + similarity) - 1e-9))


def may_widen(last: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, similarity: float) -> np.ndarray:
    """Whether a stretch of x that goes beyond low..high may be near any of some windows,
    which have the shingles of x at places from ``first`` to ``last``, if any (-1).

    One longer than width begins and ends in common names, so the other holds their
    places; both conditions of ``near`` then part into one of each end.
    """
    full = last.shape[1]
    middle, factor = full // 2, np.float32((1 + similarity) / similarity)
    flags, i = last >= 0, np.arange(full, dtype=np.float32)
    sums = np.zeros((len(flags), full + 1), np.int16)
    np.cumsum(flags, 1, out=sums[:, 1:])
    k = _begins(full, width)
    beyond = (k < low[:, None]) | (k + width - 1 > high[:, None])
    may = ((sums[:, k + width] - sums[:, k] >= _least(width, similarity)) & beyond).any(1)
    begin, end = sums[:, : middle + 1] * factor - i[: middle + 1], sums[:, middle + 1 :] * factor - i[middle:]
    left, right = flags[:, : middle + 1], flags[:, middle:]
    new_left, new_right = left & (i[: middle + 1] < low[:, None]), right & (i[middle:] > high[:, None])
    for x, y, gap in ((begin, end, width + 1), (begin - last[:, : middle + 1], end - first[:, middle:], 2)):
        new_left &= x <= np.where(right, y, -np.inf).max(1)[:, None] - np.float32(gap - 1e-2)
        new_right &= y >= np.where(left, x, np.inf).min(1)[:, None] + np.float32(gap - 1e-2)
    return may | new_left.any(1) | new_right.any(1)


#: Pairs that are compared at a time, and windows that are held for it.
PAIRS, ROWS = 1 << 10, 1 << 13
#: Forms from which on a group is compared by classes, entries of a class table, meetings
#: in all and at a time.
CROWD, TABLE, MEETINGS, MET = 48, 1 << 24, 1 << 28, 1 << 20
#: Classes that are held against all others at a time.
UNITS = 256


class _Crowd:
    """Forms of one group, compared by what most of them hold.

    Names are frequent or rare.  Two forms that share a rare name meet in its list and are
    compared as they are.  Any others have nothing but frequent names in common, so what
    these forms make of each other is what their classes do: forms alike in frequent names
    and, for the side that is judged, in where they may end.  A class counts for a form
    only if one of its members neither meets the form nor is of the same text alone, so
    every pair is judged as it would be by itself.
    """

    def __init__(self, number: np.ndarray, there: np.ndarray, shape: np.ndarray, own: np.ndarray, texts: tuple[np.ndarray, np.ndarray], bounds: tuple[np.ndarray, np.ndarray], width: int, similarity: float):
        self.width, self.similarity, self.full, self.n_cases = width, similarity, number.shape[1], len(shape)
        self.need = _least(width, similarity)
        rich = (number >= 0).sum(1) >= self.need
        # a form with fewer names that others hold is near none
        self.cases = np.flatnonzero(rich[shape])
        self.form, self.own = (np.cumsum(rich) - 1)[shape[self.cases]], own[self.cases]
        number, self.there = number[rich], there[rich]
        self.low_text, self.high_text, self.least, self.most = (x[rich] for x in (*texts, *bounds))
        self.n, self.flags = len(number), number >= 0
        _, inverse, self.count = np.unique(number[self.flags], return_inverse=True, return_counts=True)
        self.name = np.full(number.shape, -1, np.int32)
        self.name[self.flags] = inverse
        self.held = np.zeros(number.shape, np.int32)
        self.held[self.flags] = self.count[inverse]

    def _reach(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where stretches that have frequent names in common alone may begin and end."""
        slack = self.width - self.need
        first, last = frequent.argmax(1), self.full - 1 - frequent[:, ::-1].argmax(1)
        return np.maximum(first - slack, 0), np.minimum(last + slack, self.full - 1)

    def plan(self) -> int | None:
        """Up to how many forms hold a rare name, for the least work; none if all pairs
        are less."""
        if not self.n:
            return 0
        rng = np.random.default_rng(1)
        names, places, ends = (rng.integers(1, 1 << 63, k, np.uint64) for k in (len(self.count), self.full, self.full))
        mixed = names[self.name] * (places | np.uint64(1)) * self.flags
        there = np.concatenate([np.zeros((self.n, 1), np.uint64), np.cumsum(self.there * ends, 1, dtype=np.uint64)], 1)
        rows, best, least = np.arange(self.n), None, float(len(self.cases)) * self.n
        top = int(self.count.max())
        for rare in (1 << np.arange(top.bit_length() + 1)).tolist():
            frequent = self.held > rare
            enough = frequent.sum(1) >= self.need
            y = (mixed * frequent).sum(1, dtype=np.uint64)
            a, b = self._reach(frequent)
            x = y * np.uint64(0x9E3779B97F4A7C15) + there[rows, b + 1] - there[rows, a]
            meetings = int(((c := self.count[self.count <= rare].astype(np.int64)) * (c - 1)).sum())
            if meetings > MEETINGS:
                break
            frequents = int((self.count > rare).sum())
            if len(np.unique(y)) * (frequents + 1) <= TABLE:
                work = len(np.unique(x[enough])) * len(np.unique(y[enough])) * (0.1 + frequents / 5000) + 0.3 * meetings + 10 * self.n
                if work < least:
                    best, least = rare, work
        return best

    def spans(self, rare: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last shingle that each case has in common with others."""
        low, high = np.full(self.n_cases, self.full), np.full(self.n_cases, -1)
        if self.n and len(self.cases):
            self._classes(rare)
            self.low, self.high = np.full(len(self.cases), self.full), np.full(len(self.cases), -1)
            self._alike()
            self._by_class(self._barred())
            self._met()
            low[self.cases], high[self.cases] = self.low, self.high
        return low, high

    def _classes(self, rare: int) -> None:
        frequent = self.held > rare
        n_frequent = int((self.count > rare).sum())
        again = np.full(len(self.count) + 1, n_frequent, np.int32)
        again[:-1][self.count > rare] = np.arange(n_frequent)
        self.again = np.where(frequent, again[self.name], n_frequent).astype(np.int32)
        self.n_frequent = frequent.sum(1)
        _, first, self.y = _alike(self.again)
        order = np.argsort(-self.n_frequent[first], kind="stable")
        first, self.y = first[order], np.argsort(order, kind="stable")[self.y]
        self.members = np.bincount(self.y)
        self.n_y = int((self.n_frequent[first] >= self.need).sum())
        self.place = np.full((len(first), n_frequent + 1), -1, np.int16)
        row, at = np.nonzero(frequent[first])
        self.place[row, self.again[first][row, at]] = at
        a, b = self._reach(frequent)
        i = np.arange(self.full)
        self.edge = self.there & (i >= a[:, None]) & (i <= b[:, None])
        _, self.x_first, self.x = _alike(np.where(frequent, self.again, np.where(self.edge, -2, -1)))
        # where the rare names are
        self.rare = self.flags & ~frequent & (self.held > 1)
        row, at = np.nonzero(self.rare)
        name = self.name[row, at]
        order = np.argsort(name, kind="stable")
        self.post_form, self.post_at = row[order], at[order]
        self.start = np.searchsorted(name[order], np.arange(len(self.count)))
        self.size = np.where(self.rare, self.held, 0).sum(1, dtype=np.int64)

    def _meet(self, cases: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(case, other form, where their meetings begin and end, places in both) of forms
        that share a rare name."""
        done = np.cumsum(self.size[self.form[cases]])
        for part in np.split(cases, np.searchsorted(done, np.arange(MET, done[-1] if len(done) else 0, MET))):
            if not len(part):
                continue
            forms = self.form[part]
            row, at = np.nonzero(self.rare[forms])
            name = self.name[forms[row], at]
            n = self.count[name]
            post = np.arange(n.sum()) + np.repeat(self.start[name] - np.cumsum(n) + n, n)
            row, at, other = np.repeat(row, n), np.repeat(at, n), self.post_form[post]
            key = row * self.n + other
            on = np.flatnonzero(forms[row] != other)
            on = on[np.argsort(key[on], kind="stable")]
            key = key[on]
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            yield part, part[key[cuts] // self.n], key[cuts] % self.n, np.append(cuts, len(key)), at[on], self.post_at[post[on]]

    def _same_text(self, cases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(case, form) of forms that the case's text alone holds."""
        single = np.flatnonzero(self.low_text == self.high_text)
        single = single[np.argsort(self.low_text[single], kind="stable")]
        a, b = (np.searchsorted(self.low_text[single], self.own[cases], side) for side in ("left", "right"))
        return np.repeat(cases, b - a), single[np.arange((b - a).sum()) + np.repeat(a - np.cumsum(b - a) + b - a, b - a)]

    def _barred(self) -> np.ndarray:
        """Sorted case * classes + class of classes in which no member counts for a case."""
        out = [np.empty(0, np.int64)]
        n_all = len(self.members)
        judged = np.flatnonzero(self.n_frequent[self.form] >= self.need)
        for part, case, other, *_ in self._meet(judged):
            mine, alone = self._same_text(part)
            pairs = np.unique(np.concatenate([case * self.n + other, mine * self.n + alone, part * self.n + self.form[part]]))
            key, n = np.unique(pairs // self.n * n_all + self.y[pairs % self.n], return_counts=True)
            out.append(key[n == self.members[key % n_all]])
        return np.unique(np.concatenate(out))

    def _near(self, at: np.ndarray, x_there: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return near(at, x_there, *bounds, self.width, self.similarity)

    def _alike(self) -> None:
        """Forms of several texts are held against themselves."""
        on = np.flatnonzero(self.low_text[self.form] != self.high_text[self.form])
        for i in range(0, len(on), PAIRS):
            case, form = on[i : i + PAIRS], self.form[on[i : i + PAIRS]]
            at = np.where(self.flags[form], np.arange(self.full, dtype=np.int16), np.int16(-1))
            self._widen(case, *self._near(at, self.there[form], (self.least[form], self.most[form])))

    def _widen(self, case: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        np.minimum.at(self.low, case, first)
        np.maximum.at(self.high, case, last)

    def _by_class(self, barred: np.ndarray) -> None:
        n_all, n_frequent = len(self.members), self.place.shape[1] - 1
        # cases of a class are one unit, but for those that some classes do not count for
        apart = np.full(len(self.cases), -1, np.int64)
        apart[barred // n_all] = barred // n_all
        judged = np.flatnonzero(self.n_frequent[self.form] >= self.need)
        units, unit = np.unique(np.column_stack([self.x[self.form[judged]], apart[judged]]), axis=0, return_inverse=True)
        unit, x, apart = unit.ravel(), self.x_first[units[:, 0]], units[:, 1]
        names, edge = self.again[x], self.edge[x]
        parts = [_bound(names[i : i + 256] < n_frequent, edge[i : i + 256], self.width, self.similarity) for i in range(0, len(x), 256)]
        least, most = (np.concatenate([p[k] for p in parts] or [np.empty(0, np.int64)]) for k in (0, 1))
        low, high = np.full(len(x), self.full), np.full(len(x), -1)
        active = np.flatnonzero(least <= most)
        held = (self.place[: self.n_y, :n_frequent] >= 0).astype(np.float32)

        def judge(u: np.ndarray, k: np.ndarray) -> None:
            """Pairs of units and classes, the best first, as long as units are open."""
            while len(u):
                mine, at = u[:PAIRS], self.place[k[:PAIRS, None], names[u[:PAIRS]]]
                may = may_widen(at, at, low[mine], high[mine], self.width, self.similarity)
                mine = mine[may]
                first, last = self._near(at[may], edge[mine], (least[mine], most[mine]))
                np.minimum.at(low, mine, first)
                np.maximum.at(high, mine, last)
                u, k = u[PAIRS:], k[PAIRS:]
                on = (low[u] > least[u]) | (high[u] < most[u])
                u, k = u[on], k[on]

        buckets = None
        for i in range(0, len(active), UNITS):
            mine = active[i : i + UNITS]
            row, at = np.nonzero(names[mine] < n_frequent)
            name = names[mine[row], at]
            has = np.zeros((len(mine), n_frequent), np.float32)
            has[row, name] = 1
            common = has @ held.T
            if len(barred):
                x, y = np.searchsorted(barred, apart[mine] * n_all), np.searchsorted(barred, (apart[mine] + 1) * n_all)
                gone = np.repeat(np.arange(len(mine)), y - x), barred[np.arange((y - x).sum()) + np.repeat(y - np.cumsum(y - x), y - x)] % n_all
                on = gone[1] < self.n_y
                common[gone[0][on], gone[1][on]] = 0
            for top in (1, 8):
                left = np.flatnonzero((low[mine] > least[mine]) | (high[mine] < most[mine]))
                k = min(top, self.n_y)
                best = np.argpartition(-common[left], k - 1, axis=1)[:, :k]
                u, k = np.repeat(left, k), best.ravel()
                on = common[u, k] >= self.need
                judge(mine[u[on]], k[on])
                common[u, k] = 0
            left = np.flatnonzero((low[mine] > least[mine]) | (high[mine] < most[mine]))
            if not len(left):
                continue
            if buckets is None:
                buckets, last_at, first_at = self._buckets()
                bucket = np.empty(self.n_y, np.int64)
                for j, those in enumerate(buckets):
                    bucket[those] = j
            may = np.empty((len(left), len(buckets)), bool)
            u, k = np.repeat(np.arange(len(left)), len(buckets)), np.tile(np.arange(len(buckets)), len(left))
            for j in range(0, len(u), PAIRS):
                x, y = mine[left[u[j : j + PAIRS]]], k[j : j + PAIRS, None]
                may.ravel()[j : j + PAIRS] = may_widen(last_at[y, names[x]], first_at[y, names[x]], low[x], high[x], self.width, self.similarity)
            u, k = np.nonzero((common[left] >= self.need) & may[:, bucket])
            order = np.argsort(-common[left[u], k], kind="stable")
            judge(mine[left[u[order]]], k[order])
        self._widen(judged, low[unit], high[unit])

    def _buckets(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Classes alike in how much shorter they are than usual and in what they lack, and
        the last and the first place of each name in any of a bucket."""
        place, middle = self.place[: self.n_y, :-1], self.full // 2
        held = place >= 0
        usual = np.array([np.median(place[on, k]) if on.any() else middle for k, on in enumerate(held.T)])
        gap = np.where(held, np.where(usual <= middle, place - usual, usual - place), 0)
        left = usual <= middle
        short = sum(np.maximum(gap[:, on].max(1, initial=0), 0) for on in (left, ~left))
        size, out = max(8, int(self.n_y**0.5 / 1.5)), []
        level = np.digitize(short, (1, 3, 6, 12))
        todo = [np.flatnonzero(level == k) for k in np.unique(level)]
        while todo:
            mine = todo.pop()
            if len(mine) <= size:
                out.append(mine)
                continue
            on = held[mine, np.abs(held[mine].mean(0) - 0.5).argmin()]
            if on.all() or not on.any():
                on = np.arange(len(mine)) < len(mine) // 2
            todo += [mine[on], mine[~on]]
        last, first = (np.full((len(out), place.shape[1] + 1), x, np.int16) for x in (-1, self.full))
        for k, mine in enumerate(out):
            last[k, :-1] = place[mine].max(0)
            first[k, :-1] = np.where(held[mine], place[mine], self.full).min(0)
        return out, last, first

    def _met(self) -> None:
        least, most = self.least[self.form], self.most[self.form]
        open_ = np.flatnonzero((least <= most) & ((self.low > least) | (self.high < most)))
        for _, case, other, cuts, at_x, at_y in self._meet(open_):
            form = self.form[case]
            on = np.minimum(self.n_frequent[form], self.n_frequent[other]) + np.diff(cuts) >= self.need
            on &= ~((self.low_text[other] == self.high_text[other]) & (self.low_text[other] == self.own[case]))
            on = np.flatnonzero(on)
            for i in range(0, len(on), PAIRS):
                mine = on[i : i + PAIRS]
                at = self.place[self.y[other[mine], None], self.again[form[mine]]]
                n = cuts[mine + 1] - cuts[mine]
                meetings = np.arange(n.sum()) + np.repeat(cuts[mine] - np.cumsum(n) + n, n)
                at[np.repeat(np.arange(len(mine)), n), at_x[meetings]] = at_y[meetings]
                good = ((at >= 0).sum(1) >= self.need) & ((self.low[case[mine]] > least[case[mine]]) | (self.high[case[mine]] < most[case[mine]]))
                if good.any():
                    c = case[mine[good]]
                    self._widen(c, *self._near(at[good], self.there[form[mine[good]]], (least[c], most[c])))


def _alike(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows, the first place of each, and which one every row is."""
    rows = np.ascontiguousarray(rows.astype(np.int32))
    found, first, which = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
    return found, first, which.ravel()


class _Batch:
    """Windows of many groups whose pairs are compared together.

    Every form is compared with the others of its group in turn, those that have most
    shingles in common with any first, until its span has reached what it can reach.
    Pairs whose common shingles can't widen the span are passed over; no others are.
    """

    def __init__(self, width: int, reach: int, similarity: float):
        self.width, self.reach, self.similarity, self.full = width, reach, similarity, 2 * reach - 1
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple[int, bytes]] = []
        self.members: list[tuple[int, list[int], bool]] = []
        self.group: list[int] = []

    def add(self, around: list[tuple[int, bytes]], members: list[tuple[int, list[int], bool]]) -> None:
        """A group of different windows; the flag says that several texts hold one."""
        self.group += [self.group[-1] + 1 if self.group else 0] * len(around)
        self.rows += around
        self.members += members

    def _names(self) -> np.ndarray:
        out = np.zeros((len(self.rows), self.full), np.uint32)
        for i, (m, raw) in enumerate(self.rows):
            first = self.reach - 1 - m
            out[i, first : first + len(raw) // 4] = np.frombuffer(raw, np.uint32)
        return np.concatenate([own_names(out[i : i + ROWS]) for i in range(0, len(out), ROWS)])

    def compare(self) -> tuple[np.ndarray, np.ndarray]:
        """The verified span of each window that one text holds; all hold c, so it is one."""
        full, names = self.full, self._names()
        group, many = np.array(self.group), np.array([x for _, _, x in self.members])
        text = np.array([t for t, _, _ in self.members], np.int64)
        least_text, most_text = np.where(many, -(2**63), text), np.where(many, 2**63 - 1, text)
        # number the names that several texts of a group hold; -1 is none, -2 another name
        key = ((group.astype(np.uint64) << np.uint64(32))[:, None] | names).ravel()
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        owner = order // full
        shared = (np.minimum.reduceat(least_text[owner], cuts) != np.maximum.reduceat(most_text[owner], cuts)) & (names.ravel()[order[cuts]] > 0)
        number = np.empty(len(key), np.int32)
        number[order] = np.repeat(np.where(shared, np.cumsum(shared) - 1, -2), np.diff(cuts, append=len(key)))
        number = number.reshape(names.shape)
        number[names == 0] = -1
        n_names = int(shared.sum())
        # forms, those of a group together and the richest first
        _, first, form = _alike(np.column_stack([group, number]))
        rank = np.lexsort((first, -(number[first] >= 0).sum(1), group[first]))
        form, first = np.argsort(rank, kind="stable")[form], first[rank]
        number, there, of = number[first], names[first] > 0, group[first]
        low_text, high_text = np.full(len(first), 2**63 - 1), np.full(len(first), -(2**63))
        np.minimum.at(low_text, form, least_text)
        np.maximum.at(high_text, form, most_text)
        begin = np.searchsorted(of, np.arange(of[-1] + 1))
        size = np.diff(begin, append=len(of))
        found = [_bound(number[i : i + 256] >= 0, there[i : i + 256], self.width, self.similarity) for i in range(0, len(of), 256)]
        least, most = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
        # a text with one form in its group shares the result of all that have it
        single = np.flatnonzero(~many)
        pairs = np.unique(np.column_stack([group[single], text[single], form[single]]), axis=0)
        twice = np.zeros(len(pairs), bool)
        again = (pairs[1:, :2] == pairs[:-1, :2]).all(1)
        twice[1:] |= again
        twice[:-1] |= again
        alone = np.where(twice, pairs[:, 1], np.where(low_text[pairs[:, 2]] == high_text[pairs[:, 2]], low_text[pairs[:, 2]], 2**63 - 1))
        cases, case = np.unique(np.column_stack([pairs[:, 2], alone]), axis=0, return_inverse=True)
        shape, own = cases[:, 0], cases[:, 1]
        low, high = np.full(len(cases), full), np.full(len(cases), -1)
        place = np.full(n_names + 2, -1, np.int16)
        column = np.broadcast_to(np.arange(full, dtype=np.int16), number.shape)
        left = least[shape] <= most[shape]
        cut = np.searchsorted(of[shape], np.arange(len(size) + 1))
        for k in np.flatnonzero(size >= CROWD).tolist():
            forms, mine = slice(begin[k], begin[k] + size[k]), slice(cut[k], cut[k + 1])
            crowd = _Crowd(number[forms], there[forms], shape[mine] - begin[k], own[mine], (low_text[forms], high_text[forms]), (least[forms], most[forms]), self.width, self.similarity)
            if (rare := crowd.plan()) is not None:
                low[mine], high[mine] = crowd.spans(rare)
                left[mine] = False
        active, step = np.flatnonzero(left), 0
        while len(active):
            partner = begin[of[shape[active]]] + step
            y = np.unique(partner)
            held = number[y] >= 0
            place[number[y][held]] = column[y][held]
            on = ~((low_text[partner] == high_text[partner]) & (low_text[partner] == own[active]))
            mine, partner = active[on], partner[on]
            for i in range(0, len(mine), PAIRS):
                self._widen(mine[i : i + PAIRS], shape[mine[i : i + PAIRS]], place, number, there, least, most, low, high)
            place[number[y][held]] = -1
            step += 1
            active = active[((low[active] > least[shape[active]]) | (high[active] < most[shape[active]])) & (size[of[shape[active]]] > step)]
        out = np.full((2, len(many)), -1)
        out[0] = full
        where = np.empty(len(single), np.int64)
        index = {tuple(p): int(c) for p, c in zip(pairs.tolist(), case.ravel().tolist(), strict=True)}
        for k, p in enumerate(zip(group[single].tolist(), text[single].tolist(), form[single].tolist(), strict=True)):
            where[k] = index[p]
        out[0, single], out[1, single] = low[where], high[where]
        return out[0], out[1]

    def _widen(self, case, x, place, number, there, least, most, low, high) -> None:  # noqa: ANN001, PLR0913
        """Spans of the cases (forms x) by what they have in common with their partners,
        whose names have their places in ``place``."""
        at = place[number[x]]
        on = np.flatnonzero((at >= 0).sum(1) >= _least(self.width, self.similarity))
        on = on[may_widen(at[on], at[on], low[case[on]], high[case[on]], self.width, self.similarity)]
        if not len(on):
            return
        case, x, at = case[on], x[on], at[on]
        first, last = near(at, there[x], least[x], most[x], self.width, self.similarity)
        low[case], high[case] = np.minimum(low[case], first), np.maximum(high[case], last)

    def spans(self) -> dict | None:
        if not self.rows:
            return None
        low, high = self.compare()
        out = []
        for k in np.flatnonzero(high >= 0).tolist():
            t, places, _ = self.members[k]
            a, b = int(low[k]) - self.reach + 1, int(high[k]) - self.reach + 1
            out += [(t, c + a, c + b) for c in places]
        self.clear()
        return _columns(out) if out else None


def _compare(width: int, reach: int, similarity: float):
    """Verified spans (t, a, b), b inclusive; rows come sorted by (key, m, around).  A row
    without t stands for a window that several texts hold."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held = _Batch(width, reach, similarity)
        out: list[tuple[int, int, int]] = []
        value, around, members, settled = None, [], [], False
        for batch in batches:
            for v, t, c, m, raw in zip(*(batch[n].to_pylist() for n in ("key", "t", "c", "m", "around")), strict=True):
                if v != value:
                    if len(around) > 1:
                        held.add(around, members)
                        if len(held.rows) > ROWS and (made := held.spans()):
                            yield made
                    value, around, members = v, [], []
                if around and around[-1] == (m, raw):  # equal throughout: settled, but one text stands for them
                    first, places, _ = members[-1]
                    if t is None or (first == t and not settled):
                        places += [] if t is None else [c]
                        continue
                    n = len(raw) // 4
                    out.append((t, c - m, c - m + n - 1))
                    if not settled:
                        out += [(first, x - m, x - m + n - 1) for x in places]
                        settled = True
                        members[-1] = (first, places, True)
                else:
                    around.append((m, raw))
                    members.append((0, [], True) if t is None else (t, [c], False))
                    settled = t is None
                if len(out) > 1 << 14:
                    yield _columns(out)
                    out = []
        if len(around) > 1:
            held.add(around, members)
        if made := held.spans():
            yield made
        if out:
            yield _columns(out)

    return run


def _columns(rows: list[tuple[int, int, int]]) -> dict:
    t, a, b = zip(*set(rows), strict=True)
    return {"t": list(t), "a": list(a), "b": list(b)}


def _large_groups(around: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """Rows to compare (key, t, c, m, around) of groups with many windows, and spans of
    windows that several texts hold, which count once from there on."""
    around = materialize(around)
    same = ["v", "m", "around"]
    classes = materialize(around.groupBy(*same).agg(F.min("t").alias("x"), F.max("t").alias("y")))
    many = classes.where("x <> y").select(*same)
    settled = around.join(many, same).select("t", (F.col("c") - F.col("m")).alias("a"), (F.col("c") - F.col("m") + F.length("around") / 4 - 1).cast("int").alias("b"))
    rows = around.join(many, same, "left_anti").select(*same, "t", "c")
    rows = rows.unionByName(many.withColumns({"t": F.lit(None).cast("long"), "c": F.lit(0)}))
    blocks = materialize(classes.groupBy("v").agg(F.ceil(2 * F.count("*") / group).alias("blocks")))
    rows = rows.join(blocks, "v").withColumn("i", F.pmod(F.xxhash64("m", "around"), F.col("blocks")))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("v", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "t", "c", "m", "around"), settled


def _merge(shingle: int, words: int):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            runs = []
            for spans, n, many in zip(batch["spans"].to_pylist(), batch["n"].to_pylist(), batch["many"].to_pylist(), strict=True):
                found = [(0, n)] if many and n >= words else []
                merged: list[list[int]] = []
                for a, b in sorted(found + [(s["a"], s["b"] + shingle) for s in spans or ()]):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                runs.append([{"begin": a, "end": b} for a, b in merged])
            yield {"id": batch["id"], "n_words": batch["n"], "spans": runs}

    return run


def _count(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        n = []
        for a in range(0, len(batch["id"]), 256):
            n += [len((x or "").encode().split()) for x in batch["text"].slice(a, 256).to_pylist()]
        yield {"id": batch["id"], "t": batch["t"], "n": n}


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, shingle: int = SHINGLE, hashes: int = HASHES, group: int = GROUP) -> DataFrame:
    """Rows (id, n_words, spans): stretches of words that lie in passages of ``words``
    words or more with a near-duplicate in another document; ends are exclusive.

    Words are what white space separates, A-Z in lower case; texts of any length are read
    whole.  Null and empty texts have none.  Equal texts are each other's duplicates as a
    whole if they are long enough; in the search they are one text.  Passages that a
    document repeats within itself alone don't count.  Rows that repeat are documents of
    equal texts; a null id is kept; an empty table gives no rows; other columns are not
    read, whatever their names.  ``group`` changes how the work is dealt, not the result.
    """
    width = words - shingle + 1
    reach = int(REACH * width)
    keyed, firsts = keyed_texts(docs, id_col, text_col)
    found = map_arrow(keyed.select("t", "text"), _windows(width, reach, shingle, hashes), "key long, v long, t long, p long")
    shared = materialize(repeated(found, across=True))
    counts = shared.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > group).select("v")
    large = materialize(counts)

    def contexts(part: DataFrame) -> DataFrame:
        places = part.groupBy("t").agg(F.collect_set(F.struct("v", "p")).alias("at"))
        # one row of each text brings the words
        texts = keyed.join(places.join(firsts.select("t", "id"), "t"), ["t", "id"]).select("t", "text", "at")
        return map_arrow(texts, _contexts(shingle), "v long, t long, c int, m int, around binary")

    settled = None
    if large.limit(1).count():
        more, settled = _large_groups(contexts(shared.join(large, "v", "left_semi")), group)
        rows = contexts(shared.join(large, "v", "left_anti")).withColumnRenamed("v", "key").unionByName(more)
    else:
        rows = contexts(shared).withColumnRenamed("v", "key")
    spans = map_arrow(rows.repartition("key").sortWithinPartitions("key", "m", "around", "t", "c"), _compare(width, reach, similarity), "t long, a int, b int")
    spans = spans.union(settled) if settled is not None else spans
    spans = spans.groupBy("t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    marks = materialize(spans.join(firsts.where("n > 1").select("t", F.lit(True).alias("many")), "t", "full_outer"))
    sizes = map_arrow(keyed.select("id", "t", "text"), _count, "id long, t long, n long")
    out = map_arrow(sizes.join(marks, "t", "left").select("id", "n", "spans", F.coalesce("many", F.lit(False)).alias("many")), _merge(shingle, words), "id long, n_words long, spans array<struct<begin:long,end:long>>")
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))
