"""The batched search against the kernel, read by read."""

import random

import pytest

from palisade.functions import batched, kernels
from palisade.params import Params


def _reads(n: int) -> list:
    rnd = random.Random(5)

    def dna(k, letters="ACGT"):
        return "".join(rnd.choice(letters) for _ in range(k))

    def changed(s, k):
        s = list(s)
        for _ in range(k if s else 0):
            i, kind = rnd.randrange(len(s)), rnd.random()
            if kind < 0.4:
                s[i] = rnd.choice("ACGTN")
            elif kind < 0.6 and len(s) > 1:
                del s[i]
            elif kind < 0.8:
                s.insert(i, rnd.choice("ACGT"))
            elif i + 1 < len(s):
                s[i], s[i + 1] = s[i + 1], s[i]
        return "".join(s)

    out = [None, "", "A" * 300, dna(3000)]
    while len(out) < n:
        if rnd.random() < 0.15:
            out.append(dna(rnd.randrange(0, 400), rnd.choice(["ACGT", "AC"])))
            continue
        repeat, base = dna(rnd.randrange(20, 50), rnd.choice(["ACGT", "ACGT", "AC", "AAAAAAACGT", "ACGTN"])), dna(rnd.randrange(26, 51))
        seq = dna(rnd.randrange(0, 50))
        for _ in range(rnd.randrange(1, 7)):
            spacer = rnd.choice([base, changed(base, rnd.randrange(9)), changed(repeat, rnd.randrange(9)), dna(rnd.randrange(24, 53)), dna(30), ""])
            seq += changed(repeat, rnd.choice([0, 0, 0, 0, 1, 2])) + spacer
        seq += repeat + dna(rnd.randrange(0, 50))
        out.append(rnd.choice([seq] * 20 + [seq.lower(), seq[:50] + "é" + seq[50:]]))
    return out


@pytest.mark.parametrize("p", [Params(), Params(min_repeat=10, min_spacer=10, window=6).checked(), Params(min_repeats=3, max_spacer=80), Params(max_spacer=150, max_repeat=120)])
def test_batch_finds_what_the_kernel_finds(p):
    seqs = _reads(1500)
    rows, lengths, counts, starts, stops = batched.find_repeats(seqs, p)
    got, at = {}, 0
    for row, length, n in zip(rows.tolist(), lengths.tolist(), counts.tolist()):
        got[row] = (length, [list(x) for x in zip(starts[at : at + n].tolist(), stops[at : at + n].tolist())])
        at += n
    want = {i: f for i, s in enumerate(seqs) if (f := kernels.find_repeats(s, p))}
    assert len(want) > 100 and got == want
    assert list(got) == sorted(got)


def test_nothing_to_search():
    assert [len(x) for x in batched.find_repeats([], Params())] == [0] * 5
    assert [len(x) for x in batched.find_repeats([None, "ACGT"], Params())] == [0] * 5


def test_alignment_of_many_pairs_is_that_of_each():
    rnd = random.Random(3)
    variants, masters, longer = [], [], []
    for _ in range(150):
        master = "".join(rnd.choice(rnd.choice(["ACGT", "ACGTN", "AC"])) for _ in range(rnd.randrange(20, 48)))
        v = master[rnd.randrange(8) : len(master) - rnd.randrange(6)]
        v = rnd.choice([v, kernels._complement(v), v[:9] + "GG" + v[11:], v[:7] + v[8:], "ACGT" * 6, master])
        variants.append(v)
        masters.append(master)
        longer.append(rnd.choice([None, "AC" + v + "GT"]))
    scores, shifts = batched.align(variants, masters)
    assert list(zip(scores.tolist(), shifts.tolist())) == [kernels.align(v, m) for v, m in zip(variants, masters)]
    assert batched.offsets_to_masters(variants, masters, longer) == [kernels.offset_to_master(*x) for x in zip(variants, masters, longer)]
    assert batched.offsets_to_masters([], [], []) == []
