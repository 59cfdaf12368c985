"""Exact draws of discrete Laplace noise, many at a time, from the operating system's random source.

All probabilities are ratios of integers and all draws are uniform integers, so no rounding of floats shapes the
distribution or cuts its tails (Canonne, Kamath and Steinke, "The discrete Gaussian for differential privacy",
algorithms 1 and 2).
"""

from __future__ import annotations

import math
import os

import numpy as np

STEPS = 1 << 20  # epsilon is rounded down to a multiple of 1 / STEPS: never less noise than asked for


def below(n: int, bound: int) -> np.ndarray:
    """``n`` uniform integers from 0 to below ``bound`` (2**62 at most)."""
    if bound == 1:
        return np.zeros(n, np.int64)
    bits = (bound - 1).bit_length()
    out = np.empty(n, np.int64)
    todo = np.arange(n)
    while len(todo):
        drawn = (np.frombuffer(os.urandom(8 * len(todo)), np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        good = drawn < bound
        out[todo[good]] = drawn[good]
        todo = todo[~good]
    return out


def exp_minus(u: np.ndarray, t: int) -> np.ndarray:
    """True with probability exp(-u / t), for each u from 0 to t."""
    out = np.zeros(len(u), bool)
    alive, k = np.arange(len(u)), 1
    while len(alive):
        on = below(len(alive), t * k) < u[alive]
        out[alive[~on]] = k % 2 == 1
        alive, k = alive[on], k + 1
    return out


def _runs(n: int) -> np.ndarray:
    """How many draws in a row come out true that do so with probability 1 / e."""
    out = np.zeros(n, np.int64)
    alive = np.arange(n)
    while len(alive):
        alive = alive[exp_minus(np.ones(len(alive), np.int64), 1)]
        out[alive] += 1
    return out


def discrete_laplace(n: int, epsilon: float, l1: int) -> np.ndarray:
    """``n`` draws with P(x) in proportion to exp(-epsilon * |x| / l1)."""
    s, t = math.floor(epsilon * STEPS), l1 * STEPS
    if s < 1 or t > 1 << 56:
        raise ValueError("epsilon is too small or the contribution bound too large for exact noise")
    s, t = s // math.gcd(s, t), t // math.gcd(s, t)
    out = np.empty(n, np.int64)
    todo = np.arange(n)
    while len(todo):
        u = below(len(todo), t)
        kept = exp_minus(u, t)
        at, u = todo[kept], u[kept]
        y = (u + t * _runs(len(u))) // s
        minus = below(len(u), 2) == 1
        good = ~(minus & (y == 0))  # zero has one sign
        out[at[good]] = np.where(minus, -y, y)[good]
        left = np.ones(n, bool)
        left[at[good]] = False
        todo = todo[left[todo]]
    return out
