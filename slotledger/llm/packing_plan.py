"""The packing plan: how many sequences of which length pattern, from a histogram of at most ``size`` lengths.

Patterns are pairs and triples of lengths that fill a sequence exactly. Non-negative least squares fits their repeat counts to the
histogram; counts are rounded down, and what they leave over is packed best fit, longest first. The plan's size depends on the
sequence length alone, however many pieces there are.
"""

from __future__ import annotations

import numpy as np

#: Gradient steps; more of them change the result by a few sequences in a hundred thousand.
STEPS = 600


def patterns(hist: np.ndarray, size: int) -> np.ndarray:
    """Rows of three lengths, descending, 0 where there is no piece; lengths occur in the histogram."""
    lengths = np.flatnonzero(hist)
    lengths = lengths[lengths > 0]
    out = [np.zeros((0, 3), dtype=np.int64)]
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    total = a + b
    two = (a >= b) & (total == size)
    out.append(np.column_stack([a[two], b[two], 0 * a[two]]))
    present = np.zeros(size + 1, dtype=bool)
    present[lengths] = True
    rest = size - total
    three = (a >= b) & (rest > 0) & (rest <= b)
    third = rest[three]
    ok = present[third]
    out.append(np.column_stack([a[three][ok], b[three][ok], third[ok]]))
    return np.concatenate(out)


def fit(hist: np.ndarray, kinds: np.ndarray, size: int) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients."""
    if not len(kinds):
        return np.zeros(0)
    used = kinds > 0
    # bring rows of the system to one scale, so that frequent lengths do not rule alone
    scale = 1 / np.sqrt(np.maximum(hist, 1.0))
    scale[0] = 0.0

    def forward(x):
        y = np.zeros(size + 1)
        for k in range(3):
            y += np.bincount(kinds[:, k], weights=x * used[:, k], minlength=size + 1)
        return y * scale

    def back(r):
        g = r * scale
        return g[kinds[:, 0]] * used[:, 0] + g[kinds[:, 1]] * used[:, 1] + g[kinds[:, 2]] * used[:, 2]

    goal = hist * scale
    v = np.ones(len(kinds))
    for _ in range(30):  # largest eigenvalue
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(kinds))
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(y - step * back(forward(y) - goal), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(hist: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for whole groups of equal pieces: (pattern, repeats)."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]  # by room
    for length in range(size, 0, -1):
        left = int(hist[length])
        room = length
        while left:
            while room <= size and not open_[room]:
                room += 1
            if room > size:
                fits = size // length
                if left >= fits:
                    open_[size - fits * length].append(((length,) * fits, left // fits))
                    left %= fits
                if left:
                    open_[size - left * length].append(((length,) * left, 1))
                break
            kind, n = open_[room].pop()
            # as many equal pieces as the room holds go into one sequence before the next one is opened
            fits = min(room // length, left)
            take = min(n, left // fits)
            if take < n:
                open_[room].append((kind, n - take))
            open_[room - fits * length].append((kind + (length,) * fits, take))
            left -= take * fits
    return [x for group in open_ for x in group]


def plan(hist: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold every piece of the histogram exactly once."""
    hist = np.asarray(hist, dtype=np.int64)
    kinds = patterns(hist, size)
    left = hist.copy()
    out: list[tuple[tuple[int, ...], int]] = []
    fitted = np.floor(fit(hist.astype(float), kinds, size) + 1e-6).astype(np.int64)
    for i in np.argsort(-fitted, kind="stable"):
        if fitted[i] <= 0:
            break
        kind = tuple(int(x) for x in kinds[i] if x)
        n = min([int(fitted[i]), *(int(left[l]) // kind.count(l) for l in kind)])
        if n > 0:
            for l in kind:
                left[l] -= n
            out.append((kind, n))
    return out + best_fit(left, size)
