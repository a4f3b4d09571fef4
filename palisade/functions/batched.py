"""The search of :mod:`kernels` over a batch of reads at once, as array work.

Seeds are looked for read by read, as text search is fast; extension, lengths and similarities are computed for all reads
of the batch together.  The result is that of :func:`kernels.find_repeats` on each read.
"""

from __future__ import annotations

import numpy as np

from ..params import MAX_REPEAT_SPACER_LENGTH_DIFFERENCE, MAX_SIMILARITY, MAX_SPACER_LENGTH_DIFFERENCE, Params
from .kernels import _complement, low_complexity, offset_to_master, scan_right

BEYOND = {np.int8: 100, np.int16: 30_000}  # distances that no limit reaches; what a step adds still fits the type
PAIRS = 8192  # pairs in hand at once, so that a band stays in the processor's cache
CULL = 8  # after so many rows of the table, pairs that are beyond their limit are dropped


def distances(text: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Edit distance (with swaps, as in the kernels) of ``text[a:a+n]`` and ``text[b:b+m]`` where it is at most ``most``,
    else ``most + 1``."""
    out = most + 1
    todo = np.flatnonzero(np.abs(n - m) <= most)
    for i in range(0, len(todo), PAIRS):
        k = todo[i : i + PAIRS]
        out[k] = np.minimum(out[k], _distances(text, a[k], n[k], b[k], m[k], most[k]))
    return out


def _cut(text: np.ndarray, at: np.ndarray, n: np.ndarray, width: int, other: int) -> np.ndarray:
    """``(width, pairs)``: the stretches side by side, ``other`` where one has ended."""
    place = np.arange(width)[:, None]
    inside = place < n
    return np.where(inside, text[np.where(inside, at + place, 0)], text.dtype.type(other))


def _distances(text, a, n, b, m, most) -> np.ndarray:
    """A band of the table, as wide as the largest limit, for all pairs at once; pairs beyond their limit leave early."""
    w, rows, high = int(most.max()), int(n.max()), int(m.max())
    kind = np.int8 if max(rows, high) + w < BEYOND[np.int8] else np.int16
    beyond, one = kind(BEYOND[kind]), kind(1)
    out = np.full(len(a), beyond, np.int64)
    left = _cut(text, a, n, rows, 1)
    # the other side starts w + 2 places in, so that the band around row i is rows i + 1 to i + 2 w + 1 of it
    right = np.full((w + 2 + max(rows, high) + w + 1, len(a)), 2, text.dtype)
    right[w + 2 : w + 2 + high] = _cut(text, b, m, high, 2)
    slope = np.arange(2 * w + 1, dtype=kind)[:, None]
    last = np.full((2 * w + 1, len(a)), beyond, kind)
    last[w:] = slope[: w + 1]
    back = np.full_like(last, beyond)
    alive, shift, most = np.arange(len(a)), (m - n + w).astype(np.int64), most.astype(kind)
    empty = np.flatnonzero(n == 0)
    out[empty] = last[shift[empty], empty]
    for i in range(1, rows + 1):
        # place d of the band is column i - w + d, whose letter is right[i + d + 1]
        here = right[i + 1 : i + 2 * w + 2]
        row = last + (here != left[i - 1])
        row[:-1] = np.minimum(row[:-1], last[1:] + one)
        if i > 2:
            swap = back + one + (here != left[i - 2]) + (right[i : i + 2 * w + 1] != left[i - 1])
            first = max(0, w + 3 - i)  # columns from 3 on
            row[first:] = np.minimum(row[first:], swap[first:])
        if i <= w:
            row[: w - i] = beyond
            row[w - i] = i
        row -= slope
        np.minimum.accumulate(row, axis=0, out=row)
        row += slope
        if i <= w:
            row[: w - i] = beyond
        np.minimum(row, beyond, out=row)
        done = np.flatnonzero(n == i)
        if len(done):
            out[alive[done]] = row[shift[done], done]
        back, last = last, row
        if i % CULL == 0 and i < rows:
            keep = np.flatnonzero((np.minimum(back, last).min(axis=0) <= most) & (n > i))
            if not len(keep):
                break
            if len(keep) < 0.8 * len(alive):
                alive, n, shift, most = alive[keep], n[keep], shift[keep], most[keep]
                left, right, back, last = left[:, keep], right[:, keep], back[:, keep], last[:, keep]
    return out


class Reads:
    """Reads with the repeats found so far, in flat arrays: ``starts`` of all of them, ``first`` and ``count`` by read."""

    def __init__(self, seqs: list[str], repeats: list[list]):
        joined = "".join(seqs)
        if joined.isascii():
            self.text = np.frombuffer(joined.encode("ascii"), np.uint8)
        else:
            self.text = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.size = np.array([len(s) for s in seqs], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        self.count = np.array([len(r) for r in repeats], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.starts = np.array([x[0] for r in repeats for x in r], np.int64)
        self.owner = np.repeat(np.arange(len(seqs)), self.count)
        self.nth = np.arange(len(self.starts)) - self.first[self.owner]
        codes = np.full(256, 4, np.int64)
        codes[[65, 67, 71, 84]] = range(4)
        self.codes = codes[np.minimum(self.text, 255)]

    def agreed(self, rows: np.ndarray, place: np.ndarray, element: np.ndarray) -> np.ndarray:
        """By read: do enough of its repeats show the same base at ``place``?"""
        n = len(self.size)
        owner = self.owner[element]
        tally = np.bincount(owner * 5 + self.codes[self.offset[owner] + place], minlength=5 * n).reshape(n, 5)
        return tally[rows, :4].max(axis=1) >= np.maximum(2, self.count[rows] - 1)

    def extend(self, window: int, min_spacer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length of the repeats of each read and all of them, as starts and stops."""
        n, final = len(self.size), self.first + self.count - 1
        apart = np.empty(len(self.starts), np.int64)
        apart[:-1] = self.starts[1:] - self.starts[:-1]
        apart[final] = np.iinfo(np.int64).max
        gap = np.minimum.reduceat(apart, self.first)
        voters, right = self.count.copy(), np.zeros(n, np.int64)
        rows = np.flatnonzero(right < gap - min_spacer)
        active = np.zeros(n, bool)
        while len(rows):
            step = int(right[rows[0]])  # all that go on have gone as far
            voters[rows] -= self.starts[final[rows]] + window + step >= self.size[rows]
            active[:] = False
            active[rows] = True
            element = np.flatnonzero(active[self.owner])
            column, of = self.starts[element] + window + step, self.owner[element]
            held = (self.nth[element] < voters[of]) & (column < self.size[of])
            rows = rows[self.agreed(rows, column[held], element[held])]
            right[rows] += 1
            rows = rows[right[rows] < gap[rows] - min_spacer]
        length = window + right
        limit, left, skipped = np.maximum(0, gap - length), np.zeros(n, np.int64), np.zeros(n, np.int64)
        rows = np.flatnonzero(left < limit)
        while len(rows):
            step = int(left[rows[0]])
            skipped[rows] += self.starts[self.first[rows]] - step <= 0
            active[:] = False
            active[rows] = True
            element = np.flatnonzero(active[self.owner])
            column, of = self.starts[element] - step - 1, self.owner[element]
            held = (self.nth[element] >= skipped[of]) & (column >= 0)
            rows = rows[self.agreed(rows, column[held], element[held])]
            left[rows] += 1
            rows = rows[left[rows] < limit[rows]]
        starts = np.maximum(0, self.starts - left[self.owner])
        stops = np.minimum(self.starts + window - 1 + right[self.owner], self.size[self.owner] - 1)
        return length + left, starts, stops


def _passing(reads: Reads, seqs: list[str], starts: np.ndarray, stops: np.ndarray, rows: np.ndarray, p: Params) -> np.ndarray:
    """Of ``rows``, those that pass all checks of the kernels."""
    rows = rows[[not low_complexity(seqs[r][starts[reads.first[r]] : stops[reads.first[r]] + 1]) for r in rows]]
    if not len(rows):
        return rows
    single = reads.count[rows] == 2
    n_spacers = reads.count[rows] - 1
    # the spacers of these reads, one after another
    of = np.repeat(np.arange(len(rows)), n_spacers)
    begin = np.cumsum(n_spacers) - n_spacers
    nth = np.arange(len(of)) - begin[of]
    element = reads.first[rows][of] + nth
    at = stops[element] + 1
    size = np.maximum(0, starts[element + 1] - at) - single[of]  # a single spacer counts without its last base
    low, high = np.minimum.reduceat(size, begin), np.maximum.reduceat(size, begin)
    repeat_at = starts[reads.first[rows]]
    repeat = stops[reads.first[rows]] - repeat_at + 1
    ends = begin + n_spacers - 1
    inner = np.add.reduceat(size, begin) - np.where(single, 0, size[ends])
    n = np.maximum(n_spacers - 1, 1)
    steps = np.where(single, 0, np.abs(size[begin] - size[ends]) / n)
    apart = np.where(single, np.abs(size[begin] - repeat), np.abs((n * repeat - inner) / n))
    fit = (low >= p.min_spacer) & (high <= p.max_spacer)
    fit &= (steps.astype(np.int64) <= MAX_SPACER_LENGTH_DIFFERENCE) & (apart.astype(np.int64) <= MAX_REPEAT_SPACER_LENGTH_DIFFERENCE)
    # pairs: neighbouring spacers; the repeat and each spacer but the last (a single one is compared)
    base = reads.offset[rows]
    before = np.flatnonzero(fit[of] & (nth < n_spacers[of] - 1))
    beside = np.flatnonzero(fit[of] & ((nth < n_spacers[of] - 1) | single[of]))
    place = base[of] + at
    a = np.concatenate([place[before], (base + repeat_at)[of[beside]]])
    la = np.concatenate([size[before], repeat[of[beside]]])
    b = np.concatenate([place[before + 1], place[beside]])
    lb = np.concatenate([size[before + 1], size[beside]])
    owner = np.concatenate([of[before], of[beside]])
    group = np.repeat([0, 1], [len(before), len(beside)])
    longest = np.maximum(la, lb)
    use = np.flatnonzero(np.minimum(la, lb) >= 3)
    most = ((1 - MAX_SIMILARITY) * longest).astype(np.int64)
    near = np.zeros(len(rows), bool)
    near[owner[use][distances(reads.text, a[use], la[use], b[use], lb[use], most[use]) <= most[use]]] = True
    # the mean similarity can only be too high where some pair is near
    all_of = np.flatnonzero(near[owner])
    exact = distances(reads.text, a[all_of], la[all_of], b[all_of], lb[all_of], longest[all_of])
    held: dict[tuple[int, int], list[float]] = {}
    for k, g, d, x, y in zip(owner[all_of].tolist(), group[all_of].tolist(), exact.tolist(), la[all_of].tolist(), lb[all_of].tolist()):
        held.setdefault((k, g), []).append(1.0 - d / max(x, y) if min(x, y) >= 3 else 0.0)
    for (k, _), shares in held.items():
        if sum(shares) / len(shares) > MAX_SIMILARITY:
            fit[k] = False
    return rows[fit]


def _candidate(seq: str, at: int, p: Params) -> tuple[int, list] | None:
    """The next seed from ``at`` on that turns up again often enough, with the repeats found from it."""
    window, size, stride = p.window, len(seq), p.stride
    near, far = p.min_repeat + p.min_spacer, p.max_repeat + p.max_spacer + window
    find, last, need = seq.find, size - p.shortest_read, p.min_repeats
    while at <= last:
        low, high = at + near, at + far
        if high > size - 1:
            high = max(low, size - 1)
        seed = seq[at : at + window]
        second = find(seed, low, high)
        if second >= 0:
            repeats = scan_right(seq, [[at, at + window - 1], [second, second + window - 1]], seed, p.min_spacer)
            if len(repeats) >= need:
                return at, repeats
        at += stride
    return None


def find_repeats(seqs: list, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(reads, lengths, counts, starts, stops)``: numbers of the reads in which repeats are found, in order, the length
    of the repeats of each and how many it has, and all repeats of all of them."""
    found: list[tuple] = []
    todo = [(i, 0) for i, s in enumerate(seqs) if s is not None and len(s) >= p.shortest_read]
    while todo:
        numbers, repeats = [], []
        for i, at in todo:
            hit = _candidate(seqs[i], at, p)
            if hit:
                numbers.append(i)
                repeats.append(hit[1])
        if not numbers:
            break
        texts = [seqs[i] for i in numbers]
        reads = Reads(texts, repeats)
        length, starts, stops = reads.extend(p.window, p.min_spacer)
        rows = _passing(reads, texts, starts, stops, np.flatnonzero((length >= p.min_repeat) & (length <= p.max_repeat)), p)
        passed = np.zeros(len(numbers), bool)
        passed[rows] = True
        held = passed[reads.owner]
        found.append((np.array(numbers, np.int64)[rows], length[rows], reads.count[rows], starts[held], stops[held]))
        ends = stops[reads.first + reads.count - 1]
        todo = [(numbers[r], int(ends[r]) - 1 + p.stride) for r in np.flatnonzero(~passed)]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    numbers, lengths, counts, starts, stops = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(numbers, kind="stable")
    begin = np.cumsum(counts) - counts
    held = counts[order]
    pick = np.repeat(begin[order], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    return numbers[order], lengths[order], held, starts[pick], stops[pick]


def _letters(strings: list[str]) -> np.ndarray:
    """``(longest, strings)``: code points side by side, 0 where a string has ended."""
    out = np.zeros((max(map(len, strings)), len(strings)), np.int32)
    for k, x in enumerate(strings):
        out[: len(x), k] = np.frombuffer(x.encode("utf-32-le"), np.int32)
    return out


def align(queries: list[str], targets: list[str], match: int = 1, mismatch: int = -3, opening: int = 5, extension: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Scores and shifts of :func:`kernels.align` for many pairs: one cell of all tables at a time."""
    q, t = _letters(queries), _letters(targets)
    n, m = np.array([len(x) for x in queries]), np.array([len(x) for x in targets])
    unsure = [ord("N"), ord("n")]
    q_unsure, t_unsure = np.isin(q, unsure), np.isin(t, unsure)
    pairs, worst = len(queries), -(10**6)
    best, best_shift = np.zeros(pairs, np.int32), np.zeros(pairs, np.int32)
    above = [(np.zeros(pairs, np.int32), np.full(pairs, -j, np.int32)) for j in range(len(q) + 1)]
    down = [(np.full(pairs, worst, np.int32), np.zeros(pairs, np.int32))] * (len(q) + 1)

    def first(a, b):
        """The better of two, the first of equal ones."""
        other = b[0] > a[0]
        return np.where(other, b[0], a[0]), np.where(other, b[1], a[1])

    for i in range(1, len(t) + 1):
        row = [(np.zeros(pairs, np.int32), np.full(pairs, i, np.int32))]
        across = (np.full(pairs, worst, np.int32), np.zeros(pairs, np.int32))
        for j in range(1, len(q) + 1):
            pair = np.where(q_unsure[j - 1] | t_unsure[i - 1], 0, np.where(q[j - 1] == t[i - 1], match, mismatch))
            down[j] = first((above[j][0] - opening - extension, above[j][1]), (down[j][0] - extension, down[j][1]))
            across = first((row[-1][0] - opening - extension, row[-1][1]), (across[0] - extension, across[1]))
            corner = (above[j - 1][0] + pair, np.where(above[j - 1][0] != 0, above[j - 1][1], i - j))
            cell = first(first(first(corner, down[j]), across), (np.zeros(pairs, np.int32), np.full(pairs, i - j, np.int32)))
            row.append(cell)
            higher = (cell[0] > best) & (i <= m) & (j <= n)
            best, best_shift = np.where(higher, cell[0], best), np.where(higher, cell[1], best_shift)
        above = row
    return best, best_shift


def offsets_to_masters(variants: list[str], masters: list[str], longer: list[str | None]) -> list[tuple[int | None, bool]]:
    """:func:`kernels.offset_to_master` of each variant."""
    if not variants:
        return []
    ahead, shift = align(variants, masters)
    back, back_shift = align([_complement(v) for v in variants], masters)
    out: list[tuple[int | None, bool]] = []
    for v, m, x, a, s, b, r in zip(variants, masters, longer, ahead.tolist(), shift.tolist(), back.tolist(), back_shift.tolist()):
        if v == m:
            out.append((0, False))
        elif a == b:
            out.append(offset_to_master(v, m, x))
        else:
            score, offset = max(a, b), s if a > b else r
            out.append((None, False) if score < 5 or score < len(v) / 2 else (offset, b > a))
    return out


#: Codes of the letters that coverage counts; every other letter counts as an A.
_BASES = np.zeros(256, np.int64)
for _place, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    _BASES[[ord(x) for x in _pair]] = _place
COUNTED = 1 << 22  # bases in hand at once


def base_counts(seqs: list[str], groups: np.ndarray, offsets: np.ndarray, owner: np.ndarray, starts: np.ndarray, stops: np.ndarray, reach: int | None):
    """``(group, place, base, count)`` as arrays, part by part: each repeat ``starts[k]..stops[k]`` of read ``owner[k]``
    lays its read, or ``reach`` bases either side of it, along the group's master."""
    joined = "".join(seqs)
    text = np.frombuffer(joined.encode("ascii"), np.uint8) if joined.isascii() else np.minimum(np.frombuffer(joined.encode("utf-32-le"), np.uint32), 255)
    codes = _BASES[text]
    size = np.array([len(s) for s in seqs], np.int64)
    begin = np.cumsum(size) - size
    low = np.zeros(len(starts), np.int64) if reach is None else np.maximum(starts - reach, 0)
    high = size[owner] - 1 if reach is None else np.minimum(stops + reach, size[owner] - 1)
    length = np.maximum(0, high - low + 1)
    total, k = np.cumsum(length), 0
    while k < len(starts):
        e = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + COUNTED, "right")))
        n, of = length[k:e], owner[k:e]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        base = codes[np.repeat(begin[of] + low[k:e], n) + within]
        place = np.repeat(offsets[of] - starts[k:e] + low[k:e], n) + within
        if len(place):
            least, span = place.min(), int(place.max() - place.min()) + 1
            key = (np.repeat(groups[of], n) * span + place - least) * 4 + base
            keys, counts = np.unique(key, return_counts=True) if key.max() > 4 * COUNTED else (None, np.bincount(key))
            if keys is None:
                keys = np.flatnonzero(counts)
                counts = counts[keys]
            yield keys // 4 // span, keys // 4 % span + least, keys % 4, counts
        k = e
