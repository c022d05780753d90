"""Contrast codings: worked matrices, checks, hypothesis matrices."""

from fractions import Fraction

import numpy as np
import pytest

from designmat.errors import LevelError, LevelMismatchError
from designmat.plans.contrasts import Custom, Dummy, Effects, FullDummy, Helmert, Hypothesis, SeqDiff, code, hypothesis_matrix, needs_intercept

L = ["a", "b", "c", "d"]


@pytest.mark.parametrize("coding,want,names", [
    (Dummy(), [[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], "bcd"), (Dummy(base="c"), [[1, 0, 0], [0, 1, 0], [0, 0, 0], [0, 0, 1]], "abd"),
    (Effects(), [[-1, -1, -1], [1, 0, 0], [0, 1, 0], [0, 0, 1]], "bcd"), (Helmert(), [[-1, -1, -1], [1, -1, -1], [0, 2, -1], [0, 0, 3]], "bcd"),
    (Helmert(base="b"), [[1, -1, -1], [-1, -1, -1], [0, 2, -1], [0, 0, 3]], "acd"), (Helmert(base="c"), [[0, 2, -1], [-1, -1, -1], [1, -1, -1], [0, 0, 3]], "abd"),
    (SeqDiff(), [[-0.75, -0.5, -0.25], [0.25, -0.5, -0.25], [0.25, 0.5, -0.25], [0.25, 0.5, 0.75]], "bcd"), (FullDummy(), np.eye(4), "abcd"),
    (Custom([[1, 2, 3], [4, 5, 6], [7, 8, 9], [0, 1, 0]]), [[1, 2, 3], [4, 5, 6], [7, 8, 9], [0, 1, 0]], "bcd"),
])
def test_matrices(coding, want, names):
    m = code(coding, L)
    assert np.allclose(m.matrix, want) and "".join(m.names) == names and m == code(coding, L) and hash(m) == hash(code(coding, L))


def test_helmert_as_permuted():
    # rows of the plain matrix in the order base, those before it, those after it
    plain = code(Helmert(), L).matrix
    assert np.allclose(code(Helmert(base="c"), L).matrix, plain[[2, 0, 1, 3]])


def test_level_order_and_errors():
    assert code(Dummy(levels=["d", "a", "c", "b"]), L).names == ("a", "c", "b")
    for coding, levels, error in [
        (Dummy(levels=["a", "b"]), L, LevelMismatchError), (Dummy(levels=[*L, "e"]), L, LevelMismatchError), (Dummy(levels=["1", "2"]), [1, 2], LevelMismatchError),
        (Dummy(base="z"), L, LevelError), (Dummy(), ["a"], LevelError), (Dummy(), [], LevelError), (Dummy(levels=["a", "a"]), ["a"], LevelError),
        (Custom([[1, 0]]), L, ValueError), (Dummy, L, TypeError),
    ]:
        with pytest.raises(error):
            code(coding, levels)
    assert code(FullDummy(), ["a"]).matrix.tolist() == [[1.0]]
    with pytest.raises(LevelMismatchError):
        code(Dummy(), L).check(["z"])


def test_hypotheses():
    h = np.array([[-1, 1, 0, 0], [0, -1, 1, 0], [0, 0, -1, 1]])
    assert np.allclose(code(Hypothesis(h, levels=L, labels=["p", "q", "r"]), L).matrix, code(SeqDiff(), L).matrix)
    assert code(Hypothesis([("p", h[0]), ("q", h[1]), ("r", h[2])], levels=L), L).names == ("p", "q", "r")
    for bad in (lambda: Hypothesis(h, levels=L), lambda: Hypothesis(h[:2], levels=L, labels=["p", "q"])):
        with pytest.raises((TypeError, ValueError)):
            bad()
    assert hypothesis_matrix(code(Dummy(), L)).tolist() == [[1, 0, 0, 0], [-1, 1, 0, 0], [-1, 0, 1, 0], [-1, 0, 0, 1]]
    assert hypothesis_matrix(code(Dummy(), L), intercept=False).tolist() == [[0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    assert hypothesis_matrix(code(Effects(), L))[0][0] == Fraction(-1, 4) and not needs_intercept(code(Effects(), L).matrix)
    assert all(not needs_intercept(SeqDiff().matrix(0, k)) for k in range(3, 9)) and needs_intercept(code(Dummy(), L).matrix)
