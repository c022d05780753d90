"""Contrast codings: which numbers stand for the levels of a categorical variable."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction
from types import SimpleNamespace
from typing import Any

import numpy as np

from designmat.errors import LevelError, LevelMismatchError


def level_text(x: Any) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    return x.isoformat() if hasattr(x, "isoformat") else str(x)


#: Levels beyond which the indicator codings are kept sparse.
DENSE = 64


class Contrast:
    """Base of all codings. Own codings define ``matrix`` and may change ``names``."""

    least = 2

    def __init__(self, base: Any = None, levels: Sequence | None = None):
        self.base, self.levels = base, None if levels is None else tuple(levels)

    def matrix(self, base: int, k: int) -> np.ndarray:
        raise NotImplementedError

    def names(self, levels: Sequence, base: int) -> list[str]:
        return [level_text(x) for i, x in enumerate(levels) if i != base]

    def _key(self) -> tuple:
        return type(self), self.base, self.levels

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Contrast) and self._key() == other._key()

    def __hash__(self) -> int:
        return hash(self._key())


class Dummy(Contrast):
    """An indicator of each level but the base."""

    def matrix(self, base: int, k: int) -> Any:
        if k > DENSE:
            return SparseMatrix([{} if i == base else {i - (i > base): 1.0} for i in range(k)], k - 1)
        return np.delete(np.eye(k), base, axis=1)


class FullDummy(Contrast):
    """An indicator of every level."""

    least = 1

    def matrix(self, base: int, k: int) -> Any:
        return SparseMatrix([{i: 1.0} for i in range(k)], k) if k > DENSE else np.eye(k)

    def names(self, levels: Sequence, base: int) -> list[str]:
        return [level_text(x) for x in levels]


class Effects(Contrast):
    """Indicators that are -1 at the base, so each column sums to zero."""

    def matrix(self, base: int, k: int) -> Any:
        if k > DENSE:
            return SparseMatrix([dict.fromkeys(range(k - 1), -1.0) if i == base else {i - (i > base): 1.0} for i in range(k)], k - 1)
        out = np.delete(np.eye(k), base, axis=1)
        out[base] = -1
        return out


class Helmert(Contrast):
    """Each level against the mean of those before it. The base row comes first, the others follow in order; for a
    base after the second level that is a permutation of rows with the same column span, not a row of -1."""

    def matrix(self, base: int, k: int) -> np.ndarray:
        step = np.arange(1, k)
        row = np.arange(k)[:, None]
        out = np.where(row < step, -1.0, np.where(row == step, step, 0.0))
        return out[[base, *range(base), *range(base + 1, k)]]


class SeqDiff(Contrast):
    """Coefficients are the differences of neighbouring levels."""

    def __init__(self, levels: Sequence | None = None):
        super().__init__(None, levels)

    def matrix(self, base: int, k: int) -> np.ndarray:
        c = np.arange(1, k)
        return np.where(np.arange(1, k + 1)[:, None] <= c, (c - k) / k, c / k)

    def names(self, levels: Sequence, base: int) -> list[str]:
        return [level_text(x) for x in levels[1:]]


class Custom(Contrast):
    """A matrix taken as it is."""

    def __init__(self, values: Any, levels: Sequence | None = None, base: Any = None):
        super().__init__(base, levels)
        self.values = values if hasattr(values, "tocoo") else np.asarray(values, float)  # sparse ones stay so

    def matrix(self, base: int, k: int) -> np.ndarray:
        if self.values.shape != (k, k - 1):
            raise ValueError(f"a contrast matrix for {k} levels has {k} rows and {k - 1} columns, not {self.values.shape}")
        return self.values

    def _key(self) -> tuple:
        return (*super()._key(), _dense(self.values).tobytes())


class Hypothesis(Custom):
    """Contrasts whose coefficients are the given weighted sums of level means: the pseudo-inverse of the weights.

    ``weights`` is a matrix with a row for each hypothesis, or pairs or a dict of label and row."""

    def __init__(self, weights: Any, levels: Sequence, labels: Sequence[str] | None = None):
        pairs = list(weights.items()) if isinstance(weights, dict) else weights
        if labels is None:
            if not isinstance(pairs, list) or not all(isinstance(p, tuple) and isinstance(p[0], str) for p in pairs):
                raise TypeError("labels are needed for a matrix of hypotheses")
            labels, pairs = [p[0] for p in pairs], [p[1] for p in pairs]
        hypotheses = np.asarray(pairs, float)
        k = len(levels)
        if hypotheses.shape != (k - 1, k) or len(labels) != k - 1:
            raise ValueError(f"{k} levels need {k - 1} hypotheses of {k} weights and as many labels")
        super().__init__(np.linalg.pinv(hypotheses), levels)
        self.labels = tuple(labels)

    def names(self, levels: Sequence, base: int) -> list[str]:
        return list(self.labels)


def _dense(m: Any) -> np.ndarray:
    return m.toarray() if hasattr(m, "toarray") else np.asarray(m)


class SparseMatrix:
    """A matrix kept as its non-zero entries by row: what a coding of very many levels can give, without a dense copy."""

    def __init__(self, rows: Sequence[dict[int, float]], width: int):
        self.rows, self.shape = [dict(r) for r in rows], (len(rows), width)

    def __getitem__(self, at: tuple) -> SparseMatrix:
        rows, cols = at
        picked = self.rows if isinstance(rows, slice) else [self.rows[i] for i in rows]
        if isinstance(cols, slice):
            return SparseMatrix(picked, self.shape[1])
        return SparseMatrix([{k: r[j] for k, j in enumerate(cols) if j in r} for r in picked], len(cols))

    def tocoo(self) -> Any:
        flat = [(i, j, v) for i, r in enumerate(self.rows) for j, v in r.items()]
        return SimpleNamespace(row=[x[0] for x in flat], col=[x[1] for x in flat], data=[x[2] for x in flat])

    def toarray(self) -> np.ndarray:
        out = np.zeros(self.shape)
        for i, r in enumerate(self.rows):
            for j, v in r.items():
                out[i, j] = v
        return out


@dataclass(frozen=True, eq=False)
class ContrastsMatrix:
    """A coding that has met the levels of a variable."""

    coding: Contrast
    levels: tuple
    names: tuple[str, ...]
    matrix: np.ndarray

    def row(self, level: Any) -> np.ndarray:
        return _dense(self.matrix)[self.levels.index(level)]

    def column(self, j: int) -> list[float]:
        """One column, a number for each level."""
        return _dense(self.matrix[:, [j]]).ravel().tolist()

    def entries(self, i: int) -> list[tuple[int, float]]:
        """The entries of a level's row that aren't zero."""
        row = self.matrix[[i], :]
        if hasattr(row, "tocoo"):
            row = row.tocoo()
            return sorted((int(j), float(v)) for j, v in zip(row.col, row.data, strict=True) if v)
        return [(j, float(v)) for j, v in enumerate(row.ravel().tolist()) if v]

    def check(self, levels: Sequence) -> ContrastsMatrix:
        """Itself, if it knows all of these levels."""
        more = [x for x in levels if x not in self.levels]
        if more:
            raise LevelMismatchError(f"levels {more} aren't among {list(self.levels)}")
        return self

    def _key(self) -> tuple:
        return type(self.coding), self.levels, self.names, _dense(self.matrix).tobytes()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, ContrastsMatrix) and self._key() == other._key()

    def __hash__(self) -> int:
        return hash(self._key())


def code(coding: Contrast, levels: Sequence) -> ContrastsMatrix:
    """Apply a coding to the levels found in the data."""
    if isinstance(coding, type):
        raise TypeError(f"{coding.__name__} is a class; an instance is needed: {coding.__name__}()")
    found = list(levels)
    own = list(coding.levels) if coding.levels is not None else found
    if len(set(own)) != len(own):
        raise LevelError(f"levels aren't unique: {own}")
    kinds = lambda xs: {(type(x) if isinstance(x, bool | str) else float, x) for x in xs}
    if kinds(own) != kinds(found):
        raise LevelMismatchError(f"levels of the coding {own} and of the data {found} differ")
    if not own:
        raise LevelError("no levels found (are all values missing?)")
    if len(own) < coding.least:
        raise LevelError(f"only one level found: {own[0]!r}; contrasts need two at least")
    if coding.base is not None and coding.base not in own:
        raise LevelError(f"base level {coding.base!r} isn't among the levels {own}")
    base = 0 if coding.base is None else own.index(coding.base)
    made = coding.matrix(base, len(own))
    return ContrastsMatrix(coding, tuple(own), tuple(coding.names(own, base)), made if hasattr(made, "tocoo") else np.asarray(made, float))


def needs_intercept(matrix: np.ndarray) -> bool:
    """Whether columns aren't orthogonal to the intercept; sums under 1e-10 are zero."""
    m = _dense(matrix).astype(float)
    return np.linalg.matrix_rank(m) < len(m) and bool((np.abs(m.sum(axis=0)) > 1e-10).any())


def hypothesis_matrix(matrix: Any, intercept: bool | None = None, tolerance: float = 1e-5) -> Any:
    """Weights of the level means that each coefficient stands for; integers or fractions unless tolerance is 0."""
    m = _dense(matrix.matrix if isinstance(matrix, ContrastsMatrix) else matrix).astype(float)
    if needs_intercept(m) if intercept is None else intercept:
        m = np.column_stack([np.ones(len(m)), m])
    h = np.linalg.pinv(m)
    if not tolerance:
        return h
    exact = [[simplest(x, tolerance) for x in row] for row in h]
    return np.array([[int(x) for x in row] for row in exact]) if all(x.denominator == 1 for row in exact for x in row) else exact


def simplest(x: float, tolerance: float) -> Fraction:
    """The fraction of the smallest denominator within a tolerance."""
    return next(f for d in range(1, math.ceil(1 / tolerance) + 2) if abs((f := Fraction(round(x * d), d)) - x) <= tolerance)
