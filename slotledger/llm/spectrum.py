"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The inertia of a shifted matrix, read off its LDL' factors, counts the eigenvalues above the shift. Bisection on these counts puts
each leading eigenvalue into an interval of its own; Rayleigh quotient iteration converges in it; counts on both sides of the result
prove its number. Eigenvalues closer than rounding can part are found together as one invariant subspace.
"""

from __future__ import annotations

import numpy as np

#: Bunch and Parlett's growth bound for a choice between 1x1 and 2x2 pivots.
PIVOT = (1 + 17**0.5) / 8
#: Counts are trusted at this many roundings of the matrix norm.
SLACK = 64
#: Eigenvalues nearer than this share of the norm are found together.
NEAR = 1e-8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: positive pivots of LDL' with complete symmetric pivoting."""
    a = matrix - shift * np.eye(len(matrix))
    above, i, n = 0, 0, len(a)
    while i < n:
        rest = a[i:, i:]
        diagonal = np.abs(np.diagonal(rest))
        p = int(np.argmax(diagonal))
        off = np.abs(np.tril(rest, -1))
        r, s = np.unravel_index(int(np.argmax(off)), off.shape)
        if diagonal[p] == 0 and off[r, s] == 0:
            break  # what is left has eigenvalues equal to the shift only
        if diagonal[p] >= PIVOT * off[r, s]:
            _swap(rest, 0, p)
            pivot = rest[0, 0]
            above += pivot > 0
            column = rest[1:, 0].copy()
            rest[1:, 1:] -= np.outer(column, column / pivot)
            i += 1
        else:  # a 2x2 pivot of this choice has one eigenvalue of either sign
            r, s = (s, r) if s > r else (r, s)
            _swap(rest, 0, s)
            _swap(rest, 1, r)
            above += 1
            columns = rest[2:, :2].copy()
            rest[2:, 2:] -= columns @ np.linalg.solve(rest[:2, :2], columns.T)
            i += 2
    return above


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues above rounding, falling, and their unit eigenvectors as columns.

    Fewer than ``k`` come back where the matrix (positive semi-definite) has a lower rank. Raises ``ArithmeticError`` if the counts
    contradict a result.
    """
    n = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0
    tiny = SLACK * max(n, 1) * np.finfo(float).eps * norm
    if norm == 0:
        return np.zeros(0), np.zeros((n, 0))
    k = min(k, count_above(matrix, tiny))
    values: list[float] = []
    vectors = np.zeros((n, 0))
    while len(values) < k:
        number = len(values) + 1
        low, high, last = _isolate(matrix, number, tiny, norm)
        found, basis = _inside(matrix, low, high, last - number + 1, vectors, tiny)
        values += list(found)
        vectors = np.column_stack([vectors, basis])
        # the certificate: as many above it and so many above its lower side, no more and no fewer
        if count_above(matrix, found[0] + tiny) > number - 1 or count_above(matrix, found[-1] - tiny) < last:
            raise ArithmeticError(f"eigenvalue {number} is not where the counts put it")
    return np.array(values[:k]), vectors[:, :k]


def _isolate(matrix: np.ndarray, number: int, tiny: float, norm: float) -> tuple[float, float, int]:
    """(low, high, last): eigenvalues ``number`` to ``last`` and no others lie between; more than one only where rounding hides the gap."""
    low, high = 0.0, norm + tiny
    many, fewer = count_above(matrix, low), 0
    while (many > number or fewer < number - 1) and high - low > NEAR * norm:
        middle = (low + high) / 2
        above = count_above(matrix, middle)
        if above >= number:
            low, many = middle, above
        else:
            high, fewer = middle, above
    while (more := count_above(matrix, low - NEAR * norm)) > many and low > tiny:  # neighbours too near to be told apart
        low, many = low - NEAR * norm, more
    return low, high, many


def _inside(matrix: np.ndarray, low: float, high: float, size: int, found: np.ndarray, tiny: float) -> tuple[np.ndarray, np.ndarray]:
    """The eigenpairs in an interval that holds ``size`` eigenvalues, orthogonal to those found before."""
    n = len(matrix)
    basis = np.cos(np.arange(1, n * size + 1, dtype=float) ** 1.5).reshape(n, size)
    while True:
        middle = (low + high) / 2
        for _ in range(3):  # inverse iteration from the middle points the start to the interval
            basis = _orthonormal(_solve(matrix, middle, basis, tiny), found)
        if size > 1:
            for _ in range(500):
                image = matrix @ basis
                inner = basis.T @ image
                if np.abs(image - basis @ inner).max() <= tiny / 8:
                    break
                basis = _orthonormal(_solve(matrix, middle, basis, tiny), found)
            values, turn = np.linalg.eigh((inner + inner.T) / 2)
            return values[::-1], (basis @ turn)[:, ::-1]
        vector = basis[:, 0]
        for _ in range(12):
            value = float(vector @ matrix @ vector)
            if np.abs(matrix @ vector - value * vector).max() <= tiny / SLACK:
                break
            vector = _orthonormal(_solve(matrix, value, vector[:, None], tiny), found)[:, 0]
        value = float(vector @ matrix @ vector)
        if low - tiny <= value <= high + tiny and np.abs(matrix @ vector - value * vector).max() <= tiny:
            return np.array([value]), vector[:, None]
        # it went to a neighbour: halve the interval and start again
        if count_above(matrix, middle) > found.shape[1]:
            low = middle
        else:
            high = middle
        if high - low <= tiny:
            raise ArithmeticError("no eigenvector in an isolated interval")


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    shifted = matrix - shift * np.eye(len(matrix))
    try:
        return np.linalg.solve(shifted, right)
    except np.linalg.LinAlgError:  # exactly singular: the shift is the eigenvalue
        return np.linalg.solve(shifted - tiny / SLACK * np.eye(len(matrix)), right)


def _orthonormal(columns: np.ndarray, found: np.ndarray) -> np.ndarray:
    for _ in range(2):
        columns = columns / np.abs(columns).max(axis=0)
        columns = np.linalg.qr(columns - found @ (found.T @ columns))[0]
    return columns
