from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.functions import kernels as K
from palisade.params import Params

A = "CACCATGGAAGACCTTCCTAACACCATGGTAGACATTCCTTACACCATGGTAGACCTTCCTAACACCATGGTAGACCTTCCTAACACCATGGTAGACCTTCCTAACACCATGGTAGACCTTTCTAA"
B = "CCCCGCAGGCGCGGGGATGAACCGAGCGAGACATCACCGGCGAGTCGGAGCGCGTTGCGTTCCCCGCAGGCGCGGGGATGAACCGAAGATAAACGCCGGCG"
C = ("TTG" * 34)[:101]
REPEAT = "CTTCCACTAACCATTTCCCCGTAAGGGGACGGAAAC"
D = REPEAT + "ATTTTTTATCCAGATTTTTCCCCAAATTTGCAATAATTGCTA" + REPEAT + "TTCTGTAGAGTTATTGTATAAGAACCCCACGTAGAAACGAG" + REPEAT
E = D + "CAGAAATTACGACAGACGCGCAAGCAGGATCAGCCA" + REPEAT + "AGCCAGATAATGATGATAATGCTAGAGGCTGTCCGTT"


def marks(starts, w=8):
    return [[s, s + w - 1] for s in starts]


def starts(repeats):
    return [a for a, _ in repeats]


def test_scan_right():
    assert starts(K.scan_right(A, marks([0, 63]), "CACCATGG", 26)) == [0, 63, 105]
    for spacer in (21, 10):
        assert starts(K.scan_right(B, marks([0, 61]), "CCCCGCAG", spacer)) == [0, 61]
        assert starts(K.scan_right(D, marks([0, 78]), "CTTCCACT", spacer)) == [0, 78, 155]
    assert starts(K.scan_right(C, marks([0, 45]), "TTGTTGTT", 21)) == [0, 45, 75]
    assert starts(K.scan_right(C, marks([0, 48]), "TTGTTGTT", 24)) == [0, 48, 81]
    assert starts(K.scan_right(C, marks([0, 33]), "TTGTTGTT", 10)) == [0, 33, 51, 69, 87]


def test_extend():
    assert K.extend_repeats(A, marks([0, 63, 105]), 8, 26) == (23, [[0, 21], [62, 84], [104, 125]])
    for w in (6, 8, 11):
        assert K.extend_repeats(B, marks([0, 61], w), w, 21) == (25, [[0, 24], [61, 85]])
        assert K.extend_repeats(D, marks([0, 78, 155], w), w, 21) == (36, [[0, 35], [78, 113], [155, 190]])
    assert K.extend_repeats(C, marks([0, 45, 75]), 8, 21) == (18, [[0, 16], [44, 61], [74, 91]])
    assert K.extend_repeats(C, marks([0, 48, 81]), 8, 24) == (18, [[0, 16], [47, 64], [80, 97]])


def test_whole_search():
    length, found = K.find_repeats(E, Params())
    assert length == 36 and starts(found)[:3] == [0, 78, 155]
    assert K.find_repeats(C, Params()) is None  # low complexity
    assert K.find_repeats("ACGT", Params()) is None and K.find_repeats(None, Params()) is None


@settings(max_examples=300, deadline=None)
@given(st.text("ACGT", max_size=12), st.text("ACGT", max_size=12), st.integers(0, 5))
def test_band_agrees_with_table(a, b, most):
    assert K.within(a, b, most) == (K.edit_distance(a, b) <= most)


def test_swaps_count_once_behind_the_first_character():
    assert K.edit_distance("AACG", "AAGC") == 1
    assert K.edit_distance("CA", "AC") == 2
    assert K.edit_distance("", "AC") == 2 and K.similarity("AC", "AC") == 0.0


def test_alignment():
    assert K.align("ACGTACGTAA", "TTACGTACGTAA") == (10, 2)
    assert K.offset_to_master(REPEAT[4:], REPEAT) == (4, False)
    turned = REPEAT[4:].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert K.offset_to_master(turned, REPEAT) == (4, True)
    assert K.offset_to_master("AAAAAAAAAA", "CCCCCCCCCCCC")[0] is None


def test_partial_repeats():
    seq = REPEAT[-20:] + "ATTTTTTATCCAGATTTTTCCCCAAATTTGCAATAATTGCTA" + REPEAT
    assert K.onto_true_repeat(seq, [[62, 97]], 0, REPEAT, Params()) == [[0, 19], [62, 97]]
    seq = REPEAT + "ATTTTTTATCCAGATTTTTCCCCAAATTTGCAATAATTGCTA" + REPEAT[:15]
    assert K.onto_true_repeat(seq, [[0, 35]], 0, REPEAT, Params()) == [[0, 35], [78, 92]]


def test_parameters_fall_back_or_raise():
    import pytest

    p = Params(min_repeat=5, window=12, shared_kmers=1).checked()
    assert (p.min_repeat, p.window, p.shared_kmers, p.stride) == (23, 8, 6, 8)
    for bad in (Params(max_repeat=10), Params(max_spacer=3), Params(min_repeats=1), Params(coverage_bins=0)):
        with pytest.raises(ValueError):
            bad.checked()
