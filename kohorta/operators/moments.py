"""Per-day moment tables: all that a proportional-hazards model needs of a cohort, whatever its size.

A subject has a day, an event flag, a cell (its factor indicators) and scaled numeric covariates ``z`` with |z_i| <= 1.  The
risk-set sums of a model weigh subjects by ``exp(b'x)``.  For factors that is one number per cell.  For ``z`` the table
holds, per (model, day, event, cell), the sums of ``w0 z^a`` with ``w0 = exp(a0'z)`` at an anchor ``a0``, and

    sum exp(b'z) z^k  =  sum over a of  d^a / a!  *  (sum w0 z^(a+k)),     d = b - a0

The series is cut at total degree ``degree(q)``.  With r = |d|_1 the cut costs at most
``r^(J+1) / (J+1)! / (1 - r/(J+2)) * exp(r)`` of the sum; ``reach(q)`` is the largest r that keeps this below 1e-13.  Beyond it
the table is made again at the present estimate (one more pass).  With three or more numeric covariates the table holds
what one Newton step needs, and each step is a pass.

Tables merge by addition, so they are plain map-side combined aggregates; their size is days x cells x moments.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import cache, reduce
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEGREES = {1: 26, 2: 8}  # of the series, by the number of numeric covariates
MAX_ROWS = 1 << 20  # rows of one model's table: distinct days x event x cells


def degree(q: int) -> int:
    return DEGREES.get(q, 0)


@cache
def reach(q: int) -> float:
    """Largest |d|_1 at which the cut of the series costs at most 1e-13 of a sum."""
    j = degree(q)
    if j == 0:
        return 0.0
    r = 0.0
    while (s := r + 0.01) ** (j + 1) / math.factorial(j + 1) / (1 - s / (j + 2)) * math.exp(s) <= 1e-13:
        r = s
    return r


@cache
def powers(q: int) -> tuple[tuple[int, ...], ...]:
    """Exponents of the moments kept: total degree up to degree(q) + 2."""
    most = degree(q) + 2
    return tuple(a for a in itertools.product(range(most + 1), repeat=q) if sum(a) <= most)


@cache
def targets(q: int) -> tuple[tuple[int, ...], ...]:
    """1, z_i and z_i z_j (i <= j), as exponents."""
    unit = lambda *js: tuple(sum(i == j for j in js) for i in range(q))
    return (unit(), *(unit(i) for i in range(q)), *(unit(i, j) for i in range(q) for j in range(i, q)))


def moment_sums(z: Sequence[Column], anchor: Sequence[Column], weight: Column) -> list[Column]:
    """Aggregates ``n``, ``y0..`` (plain sums of z) and ``m0..`` (moments in the order of ``powers``)."""
    q = len(z)
    raised = [[None, x, *(F.pow(x, F.lit(float(k))) for k in range(2, degree(q) + 3))] for x in z]
    w0 = weight * F.exp(reduce(lambda a, b: a + b, [a * x for a, x in zip(anchor, z, strict=True)])) if q else weight
    out = [F.sum(weight).alias("n"), *(F.sum(weight * x).alias(f"y{i}") for i, x in enumerate(z))]
    for k, a in enumerate(powers(q)):
        factors = [raised[i][p] for i, p in enumerate(a) if p]
        out.append(F.sum(reduce(mul, factors, w0)).alias(f"m{k}"))
    return out


def moment_table(rows: DataFrame, by: Sequence[str], cell: Sequence[str], sums: Sequence[Column]) -> DataFrame:
    """The table per (``by``, t, e, ``cell``)."""
    return rows.groupBy(*by, "t", "e", *cell).agg(*sums)


class Table:
    """A model's table in memory: evaluates likelihood, gradient and information near its anchor."""

    def __init__(self, t, e, x, n, y, m, anchor: Sequence[float], numeric: Sequence[int]) -> None:
        """``x``: factor columns by row; ``numeric``: places of the numeric covariates among all terms."""
        order = np.argsort(-np.asarray(t, float), kind="stable")
        take = lambda v: np.asarray(v, float)[order]
        self.t, self.e, self.x, self.n, self.y, self.m = (take(v) for v in (t, e, x, n, y, m))
        self.starts = np.flatnonzero(np.concatenate(([True], self.t[1:] != self.t[:-1])))
        self.anchor = np.asarray(anchor, float)
        self.p = self.x.shape[1] + len(numeric)
        self.numeric = list(numeric)
        self.factors = [j for j in range(self.p) if j not in self.numeric]

    @classmethod
    def from_pandas(cls, pdf: pd.DataFrame, cell: Sequence[str], anchor: Sequence[float], numeric: Sequence[int]) -> Table:
        q = len(numeric)
        part = lambda names: pdf[list(names)].to_numpy(dtype="float64").reshape(len(pdf), -1)
        return cls(
            pdf["t"], pdf["e"], part(cell), pdf["n"], part(f"y{i}" for i in range(q)),
            part(f"m{k}" for k in range(len(powers(q)))), anchor, numeric,
        )

    def exposed(self, own: Table) -> Table:
        """This table with the subjects of ``own`` moved from 0 to 1 of one more factor, which comes last."""
        stack = lambda a, b, c: np.concatenate([a, b, c])
        wide = lambda t, v: np.column_stack([t.x, np.full(len(t.x), v)])
        out = Table(
            stack(self.t, own.t, own.t), stack(self.e, own.e, own.e), stack(wide(self, 0.0), wide(own, 1.0), wide(own, 0.0)),
            stack(self.n, own.n, -own.n), stack(self.y, own.y, -own.y), stack(self.m, own.m, -own.m), self.anchor, self.numeric,
        )
        return out

    def near(self, b: np.ndarray) -> bool:
        return float(np.abs(b[self.numeric] - self.anchor).sum()) <= reach(len(self.numeric))

    def _series(self, d: np.ndarray) -> np.ndarray:
        """Coefficients that turn moments into the sums of ``targets``."""
        q = len(d)
        place = {a: k for k, a in enumerate(powers(q))}
        out = np.zeros((len(place), len(targets(q))))
        for a in place:
            if sum(a) <= degree(q):
                c = math.prod(float(d[i]) ** a[i] / math.factorial(a[i]) for i in range(q))
                for k, target in enumerate(targets(q)):
                    out[place[tuple(i + j for i, j in zip(a, target, strict=True))], k] = c
        return out

    def sums(self, b: np.ndarray):
        """Per day from the last on: risk-set sums s0, s1, s2, those over events e0, e1, e2, events d, their x and eta sums."""
        q, p = len(self.numeric), self.p
        bf, bz = b[self.factors], b[self.numeric]
        w = (self.m @ self._series(bz - self.anchor)) * np.exp(self.x @ bf)[:, None]
        first = np.empty((len(w), p))
        first[:, self.factors] = w[:, :1] * self.x
        first[:, self.numeric] = w[:, 1 : q + 1]
        second = np.empty((len(w), p, p))
        for a, j in enumerate(self.factors):
            second[:, j, self.factors] = self.x[:, [a]] * self.x * w[:, :1]
            second[:, j, self.numeric] = self.x[:, [a]] * w[:, 1 : q + 1]
            second[:, self.numeric, j] = second[:, j, self.numeric]
        for k, (i, j) in enumerate((i, j) for i in range(q) for j in range(i, q)):
            second[:, self.numeric[i], self.numeric[j]] = second[:, self.numeric[j], self.numeric[i]] = w[:, q + 1 + k]
        plain = np.empty((len(w), p))
        plain[:, self.factors] = self.n[:, None] * self.x
        plain[:, self.numeric] = self.y
        day = lambda v: np.add.reduceat(v, self.starts, axis=0)
        dead = lambda v: day(v * self.e.reshape(-1, *[1] * (v.ndim - 1)))
        risk = [np.cumsum(day(v), axis=0) for v in (w[:, 0], first, second)]
        return (*risk, *(dead(v) for v in (w[:, 0], first, second)), dead(self.n), dead(plain), dead(plain @ b))
