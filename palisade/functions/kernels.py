"""Sequential kernels on one read or one pair of strings: plain Python, run inside Arrow batches.

Positions are 0-based and inclusive; a list of repeats is a list of ``[start, stop]``.
"""

from __future__ import annotations

from collections import Counter

from ..params import (
    LOW_COMPLEXITY,
    MAX_REPEAT_SPACER_LENGTH_DIFFERENCE,
    MAX_SIMILARITY,
    MAX_SPACER_LENGTH_DIFFERENCE,
    PARTIAL_LENGTH,
    PARTIAL_SIMILARITY,
    SCAN_RANGE,
    Params,
)


MATCH_SCORE = 1.2  # of a base that fits in a cut-off repeat; an error costs 1


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance with swaps of neighbours; a swap costs 1 only from the second character of both on."""
    if not a or not b:
        return len(a) + len(b)
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 2 and j > 2:
                best = min(best, rows[-2][j - 2] + 1 + (a[i - 2] != y) + (x != b[j - 2]))
            row.append(best)
        rows = [rows[-1], row]
    return rows[-1][-1]


def within(a: str, b: str, most: int) -> bool:
    """Is the edit distance at most ``most``?  Looks at a band of the table and stops when all of it is beyond."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    beyond = most + 1
    back: list[int] = []
    last = [min(j, beyond) for j in range(m + 1)]
    for i in range(1, n + 1):
        low, high = max(1, i - most), min(m, i + most)
        row = [beyond] * (m + 1)
        if i <= most:
            row[0] = i
        x, best = a[i - 1], beyond
        for j in range(low, high + 1):
            y = b[j - 1]
            v = last[j - 1] + (x != y)
            if last[j] < v:
                v = last[j] + 1 if last[j] + 1 < v else v
            if row[j - 1] + 1 < v:
                v = row[j - 1] + 1
            if i > 2 and j > 2:
                swap = back[j - 2] + 1 + (a[i - 2] != y) + (x != b[j - 2])
                v = swap if swap < v else v
            row[j] = v
            best = v if v < best else best
        if best > most and (i > most or i > 1) and min(last[max(0, low - 1) : high + 1]) > most:
            return False
        back, last = last, row
    return last[m] <= most


def too_similar(pairs: list[tuple[str, str]]) -> bool:
    """Is the mean similarity of the pairs above ``MAX_SIMILARITY``?  Exact only where some pair is."""
    near = [p for p in pairs if min(map(len, p)) >= 3 and within(*p, int((1 - MAX_SIMILARITY) * max(map(len, p))))]
    return bool(near) and sum(similarity(*p) for p in pairs) / len(pairs) > MAX_SIMILARITY


def similarity(a: str, b: str) -> float:
    if len(a) < 3 or len(b) < 3:
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def low_complexity(s: str) -> bool:
    most = int(len(s) * LOW_COMPLEXITY)
    upper = s.upper()
    named = [upper.count(x) for x in "ACGT"]
    return any(n > most for n in [*named, len(s) - sum(named)])


def scan_right(seq: str, repeats: list, pattern: str, min_spacer: int, reach: int = SCAN_RANGE) -> list:
    """Follow the spacing of the last two repeats to the right as long as the pattern turns up about there."""
    found, w = [list(r) for r in repeats], len(pattern)
    while True:
        last, spacing = found[-1][0], found[-1][0] - found[-2][0]
        low = max(last + spacing - reach, last + w + min_spacer)
        high = min(last + spacing + w + reach, len(seq))
        at = seq.find(pattern, low, high) if low < high else -1
        if at < 0:
            return found
        found.append([at, at + w - 1])
        if at - last < min_spacer + w:
            return found


def _agreed(chars: list, votes: int) -> bool:
    return any(n >= votes for c, n in Counter(chars).items() if c in "ACGT")


def extend_repeats(seq: str, repeats: list, window: int, min_spacer: int) -> tuple[int, list]:
    """Lengthen all repeats together while enough of them agree on the next base; ``(length, repeats)``.

    A repeat that has reached the end of the read stops voting, and takes one more voter along on each further step.
    """
    starts = [r[0] for r in repeats]
    gap = min(b - a for a, b in zip(starts, starts[1:]))
    votes = max(2, len(starts) - 1)
    voters, right = len(starts), 0
    while right < gap - min_spacer:
        if starts[-1] + window + right >= len(seq):
            voters -= 1
        columns = [s + window + right for s in starts[: max(0, voters)]]
        inside = []
        for c in columns:
            if c >= len(seq):
                break
            inside.append(seq[c])
        if not _agreed(inside, votes):
            break
        right += 1
    length, left, skipped = window + right, 0, 0
    limit = max(0, gap - length)
    while left < limit:
        if starts[0] - left <= 0:
            skipped += 1
        if not _agreed([seq[s - left - 1] for s in starts[skipped:] if s - left - 1 >= 0], votes):
            break
        left += 1
    return length + left, [[max(0, a - left), min(b + right, len(seq) - 1)] for a, b in repeats]


def interior_spacers(seq: str, repeats: list) -> list[str]:
    return [seq[a[1] + 1 : b[0]] for a, b in zip(repeats, repeats[1:])]


def passes_checks(seq: str, repeats: list, p: Params) -> bool:
    """Complexity of the repeat, then lengths and similarities of spacers."""
    repeat = seq[repeats[0][0] : repeats[0][1] + 1]
    if low_complexity(repeat):
        return False
    spacers = interior_spacers(seq, repeats)
    if len(spacers) < 2:
        spacer = spacers[0][:-1]  # in this comparison the last base doesn't count
        return (
            p.min_spacer <= len(spacer) <= p.max_spacer
            and not too_similar([(repeat, spacer)])
            and abs(len(spacer) - len(repeat)) <= MAX_REPEAT_SPACER_LENGTH_DIFFERENCE
        )
    sizes = [len(s) for s in spacers]
    if min(sizes) < p.min_spacer or max(sizes) > p.max_spacer:
        return False
    n = len(spacers) - 1
    if too_similar(list(zip(spacers, spacers[1:]))) or too_similar([(repeat, s) for s in spacers[:-1]]):
        return False
    steps = abs(sum(a - b for a, b in zip(sizes, sizes[1:])) / n)
    apart = abs(sum(len(repeat) - a for a in sizes[:-1]) / n)
    return int(steps) <= MAX_SPACER_LENGTH_DIFFERENCE and int(apart) <= MAX_REPEAT_SPACER_LENGTH_DIFFERENCE


def find_repeats(seq: str | None, p: Params) -> tuple[int, list] | None:
    """The first set of repeats that passes all checks: ``(repeat length, repeats)``."""
    if seq is None or len(seq) < p.shortest_read:
        return None
    w, at, last = p.window, 0, len(seq) - p.shortest_read
    while at <= last:
        low = at + p.min_repeat + p.min_spacer
        high = max(low, min(at + p.max_repeat + p.max_spacer + w, len(seq) - 1))
        seed = seq[at : at + w]
        second = seq.find(seed, low, high)
        if second >= 0:
            repeats = scan_right(seq, [[at, at + w - 1], [second, second + w - 1]], seed, p.min_spacer)
            if len(repeats) >= p.min_repeats:
                length, repeats = extend_repeats(seq, repeats, w, p.min_spacer)
                if p.min_repeat <= length <= p.max_repeat and passes_checks(seq, repeats, p):
                    return length, repeats
                at = repeats[-1][1] - 1
        at += p.stride
    return None


def align(query: str, target: str, match: int = 1, mismatch: int = -3, opening: int = 5, extension: int = 2) -> tuple[int, int]:
    """Affine local alignment: ``(score, target start - query start)`` of the best one, earliest end first.

    Every cell holds its score together with the shift at which its alignment began.
    """
    n, worst = len(query), (-(10**9), 0)
    best = (0, 0)
    above, down = [(0, -j) for j in range(n + 1)], [worst] * (n + 1)
    for i, t in enumerate(target, 1):
        row, across = [(0, i)], worst
        for j, q in enumerate(query, 1):
            pair = 0 if "N" in (q.upper(), t.upper()) else match if q == t else mismatch
            down[j] = max((above[j][0] - opening - extension, above[j][1]), (down[j][0] - extension, down[j][1]), key=_score)
            across = max((row[-1][0] - opening - extension, row[-1][1]), (across[0] - extension, across[1]), key=_score)
            corner = above[j - 1] if above[j - 1][0] else (0, i - j)
            row.append(max((corner[0] + pair, corner[1]), down[j], across, (0, i - j), key=_score))
            if row[-1][0] > best[0]:
                best = row[-1]
        above = row
    return best


def _score(cell: tuple[int, int]) -> int:
    return cell[0]


def _complement(s: str) -> str:
    return s.translate(str.maketrans("ACGTacgt", "TGCAtgca"))[::-1]


def offset_to_master(variant: str, master: str, longer: str | None = None) -> tuple[int | None, bool]:
    """``(offset, reversed)`` of a repeat variant along the master; no offset if it fits too badly.

    A variant that fits both ways alike is tried once more as ``longer``, which has two more bases on either side; if that
    doesn't decide, it has no offset.
    """
    if variant == master:
        return 0, False
    ahead, back = align(variant, master), align(_complement(variant), master)
    if ahead[0] == back[0]:
        if not longer:
            return None, False
        offset, turned = offset_to_master(longer, master)
        return (None if offset is None else offset + 2), turned
    (score, offset), turned = (ahead, False) if ahead[0] > back[0] else (back, True)
    return (None, False) if score < 5 or score < len(variant) / 2 else (offset, turned)


def partial_repeat(area: str, repeat: str, at_start: bool) -> int:
    """Length of a cut-off repeat at an end of a read, 0 if none: of the stretches at that end of ``area`` that are
    similar enough to a suffix (at the start) or prefix (at the end) of the repeat, the best by matches and errors."""
    best, chosen = 0.0, 0
    for n in range(PARTIAL_LENGTH + 1, min(len(area), len(repeat) - 1) + 1):
        piece, part = (area[:n], repeat[-n:]) if at_start else (area[-n:], repeat[:n])
        most = int((1 - PARTIAL_SIMILARITY) * n)
        if piece[0] != part[0] or piece[-1] != part[-1] or not within(piece, part, most):
            continue
        errors = edit_distance(piece, part)
        score = MATCH_SCORE * (n - errors) - errors
        if score >= best:
            best, chosen = score, n
    return chosen


def onto_true_repeat(seq: str, repeats: list, front: int, repeat: str, p: Params) -> list:
    """Repeats moved onto the group's true repeat, with partial ones at the ends added."""
    out = []
    for start, _ in repeats:
        a = max(0, start - front)
        out.append([a, min(a + len(repeat) - 1 - max(0, front - start), len(seq) - 1)])
    if out[0][0] > p.min_spacer:
        n = partial_repeat(seq[: out[0][0] - p.min_spacer], repeat, True)
        if n:
            out.insert(0, [0, n - 1])
    tail = len(seq) - out[-1][1]
    if tail > p.min_spacer:
        n = partial_repeat(seq[out[-1][1] + p.min_spacer :], repeat, False)
        if n:
            out.append([len(seq) - n, len(seq) - 1])
    return out
