"""Least squares from distributed QR factors.

Each task reduces its rows of [A | y] to one triangular factor per group and
fold block; factors of the same group are stacked and reduced again.  At most
(k + 1) x (k + 1) numbers per group and block travel, and unlike with Gram
matrices the condition of A isn't squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

ALPHAS = np.logspace(-6, 2, 100)  # candidates of the ridge search; fixed values


def reduce_rows(rows: np.ndarray) -> np.ndarray:
    """Triangular factor of a stack of rows (at most as many rows as columns)."""
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


class Part:
    """Summary of some rows of [A | y]: triangular factor, counts and sums."""

    __slots__ = ("r", "n", "sums")

    def __init__(self, r: np.ndarray, n: int, sums: np.ndarray):
        self.r, self.n, self.sums = r, n, sums

    @classmethod
    def of(cls, rows: np.ndarray) -> Part:
        return cls(reduce_rows(rows), len(rows), rows.sum(axis=0) if len(rows) else np.zeros(rows.shape[1]))

    @classmethod
    def merged(cls, parts: list[Part]) -> Part:
        return cls(reduce_rows(np.vstack([p.r for p in parts])), sum(p.n for p in parts), sum(p.sums for p in parts))

    @property
    def k(self) -> int:
        return self.r.shape[1] - 1

    @property
    def a(self) -> np.ndarray:
        return self.r[:, :-1]

    @property
    def b(self) -> np.ndarray:
        return self.r[:, -1]

    def rss(self, w: np.ndarray) -> float:
        return float(np.sum((self.a @ w - self.b) ** 2))

    def spread(self) -> float:
        """Centred sum of squares of y."""
        return float(np.sum(self.b**2) - self.sums[-1] ** 2 / max(1, self.n))


def partial_factors(keys: list[str], terms: list[str], target: str):
    """mapInPandas function: one row per group and block of each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Part] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            data = pdf[[*terms, target]].to_numpy(dtype=float)
            if keys:
                for key, at in pdf.groupby(keys, sort=False, dropna=False).indices.items():
                    key = key if isinstance(key, tuple) else (key,)
                    part = Part.of(data[at])
                    held[key] = Part.merged([held[key], part]) if key in held else part
            else:
                part = Part.of(data)
                held[()] = Part.merged([held[()], part]) if () in held else part
        if held:
            columns = {c: [k[i] for k in held] for i, c in enumerate(keys)}
            yield pd.DataFrame(columns | {"n": [p.n for p in held.values()], "sums": [p.sums.tolist() for p in held.values()], "r": [p.r.ravel().tolist() for p in held.values()]})

    return run


def read_parts(pdf: pd.DataFrame, width: int) -> list[Part]:
    return [Part(np.array(r, float).reshape(-1, width), int(n), np.array(s, float)) for r, n, s in zip(pdf["r"], pdf["n"], pdf["sums"])]


# -- solvers ------------------------------------------------------------------
def solve_ols(part: Part) -> np.ndarray:
    """Minimum-norm least squares; the cut-off uses the number of rows of A."""
    return np.linalg.lstsq(part.a, part.b, rcond=np.finfo(float).eps * max(part.n, part.k))[0]


def solve_ridge(part: Part, alpha: float) -> np.ndarray:
    """min |Aw - y|^2 + alpha |w|^2."""
    a = np.vstack([part.a, np.sqrt(alpha) * np.eye(part.k)])
    return np.linalg.lstsq(a, np.r_[part.b, np.zeros(part.k)], rcond=None)[0]


def solve_elastic(part: Part, alpha: float, l1_ratio: float, start: np.ndarray | None = None, rounds: int = 10_000, tol: float = 1e-10) -> np.ndarray:
    """min |Aw - y|^2 / (2n) + alpha (l1_ratio |w|_1 + (1 - l1_ratio) / 2 |w|^2)
    by cyclic coordinate descent on A'A and A'y."""
    gram, moment, n, k = part.a.T @ part.a, part.a.T @ part.b, part.n, part.k
    w = np.zeros(k) if start is None else start.copy()
    l1, l2 = n * alpha * l1_ratio, n * alpha * (1 - l1_ratio)
    grip = gram @ w
    for _ in range(rounds):
        moved = largest = 0.0
        for j in range(k):
            if gram[j, j] == 0:
                continue
            pull = moment[j] - grip[j] + gram[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (gram[j, j] + l2)
            if (step := new - w[j]) != 0:
                grip += gram[:, j] * step
                w[j] = new
            moved, largest = max(moved, abs(step)), max(largest, abs(new))
        if moved <= tol * max(largest, 1e-300):
            break
    return w


def folds(parts: dict[int, Part], k: int) -> list[tuple[Part, Part]]:
    """(training, test) of every forward-chaining fold: block 0 and all blocks
    before the test block train."""
    return [(Part.merged([parts[b] for b in range(j) if b in parts]), parts[j]) for j in range(1, k + 1)]


def ridge_search(parts: dict[int, Part], k: int) -> float:
    """Strength with the best mean R^2 over the folds; the first of equals."""
    scores = []
    splits = folds(parts, k)
    for alpha in ALPHAS:
        r2 = [1 - test.rss(solve_ridge(train, alpha)) / s if (s := test.spread()) > 0 else 0.0 for train, test in splits]
        scores.append(np.mean(r2))
    return float(ALPHAS[int(np.argmax(scores))])


def elastic_search(parts: dict[int, Part], k: int, whole: Part, l1_ratio: float) -> float:
    """Strength (normalised objective) with the least mean squared error over
    the folds, from 100 values down to a thousandth of the largest useful one."""
    ratio = l1_ratio if l1_ratio > 0 else 1e-3
    top = float(np.max(np.abs(whole.a.T @ whole.b))) / (whole.n * ratio)
    if top <= 0:
        return float(np.finfo(float).resolution)
    grid = np.geomspace(top, top * 1e-3, 100)
    errors = np.zeros(len(grid))
    for train, test in folds(parts, k):
        w = np.zeros(whole.k)
        for i, alpha in enumerate(grid):
            w = solve_elastic(train, alpha, l1_ratio, w)
            errors[i] += test.rss(w) / max(1, test.n)
    return float(grid[int(np.argmin(errors))])


def vif_from(part: Part) -> np.ndarray:
    """Variance inflation factors: each column regressed on the others without
    intercept, against its centred spread; R^2 is clamped to [0, 1]."""
    if part.k < 2:
        raise ValueError("at least 2 columns are needed")
    if part.n < 2:
        raise ValueError("at least 2 rows are needed")
    out = np.empty(part.k)
    for i in range(part.k):
        column, others = part.a[:, i], np.delete(part.a, i, axis=1)
        left = float(np.sum((others @ np.linalg.lstsq(others, column, rcond=None)[0] - column) ** 2))
        total = float(np.sum(column**2) - part.sums[i] ** 2 / part.n)
        scale = float(np.sum(column**2))
        if total <= 1e-14 * scale:
            out[i] = np.inf
            continue
        r2 = min(1.0, max(0.0, 1 - left / total))
        out[i] = np.inf if r2 >= 1.0 - 1e-15 else 1 / (1 - r2)
    return out


def compute_vif(matrix: np.ndarray) -> np.ndarray:
    """The same for a small matrix on the driver."""
    matrix = np.asarray(matrix, float)
    if matrix.ndim != 2:
        raise ValueError("a two-dimensional matrix is needed")
    if matrix.shape[1] < 2 or matrix.shape[0] < 2:
        raise ValueError("at least 2 rows and 2 columns are needed")
    return vif_from(Part.of(np.c_[matrix, np.zeros(len(matrix))]))
