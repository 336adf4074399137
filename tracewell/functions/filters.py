"""Butterworth highpass sections and zero-phase filtering over numpy matrices (row by sample).

A section's recursion is evaluated in blocks: inside a block the output is a matrix product, and only
the two state values pass from block to block, for all rows at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.model import FILTER_ORDER, KFILT_PAD, KFILT_WN

Section = tuple[float, float, float, float, float]  # b0, b1, b2, a1, a2; a0 = 1
_CACHE: dict = {}


def butter_highpass(order: int, wn: float) -> tuple[Section, ...]:
    """Second-order sections (and a first-order one for an odd order) by the bilinear transform.

    `wn` is the cutoff as a fraction of the Nyquist rate. A highpass of unit gain at Nyquist has its
    analog poles at warped / lowpass poles; conjugate pairs give one section each.
    """
    if not 0 < wn < 1:
        raise ValueError(f"cutoff {wn}: outside (0, 1)")
    warped = 2.0 * math.tan(math.pi * wn / 2.0)
    pairs, single = [], []
    for k in range((order + 1) // 2):
        angle = math.pi * (2 * k + order + 1) / (2 * order)
        real, imag = warped * math.cos(angle), warped * math.sin(angle)
        if 2 * k + 1 == order:
            d = 2.0 - real
            single.append((2.0 / d, -2.0 / d, 0.0, (-2.0 - real) / d, 0.0))
        else:
            square = real * real + imag * imag
            d = 4.0 - 4.0 * real + square
            pairs.append((4.0 / d, -8.0 / d, 4.0 / d, (2.0 * square - 8.0) / d, (4.0 + 4.0 * real + square) / d))
    return (*pairs, *single)


def butter_sections(cutoffs: DataFrame, order: int = FILTER_ORDER) -> DataFrame:
    """(wn, section, b0, b1, b2, a1, a2) for each distinct cutoff of (wn)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [(wn, i, *map(float, s)) for wn in batch.column(0).to_pylist() for i, s in enumerate(butter_highpass(order, wn))]
            kinds = [pa.float64(), pa.int32(), *[pa.float64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["wn", "section", "b0", "b1", "b2", "a1", "a2"])

    return cutoffs.select("wn").distinct().mapInArrow(run, "wn double, section int, b0 double, b1 double, b2 double, a1 double, a2 double")


def _blocks(section: Section, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matrices of a block: outputs from inputs, outputs from the state, state from inputs, state from state."""
    if (section, size) not in _CACHE:
        b0, b1, b2, a1, a2 = section
        step = np.array([[-a1, 1.0], [-a2, 0.0]])  # state to state
        push = np.array([b1 - a1 * b0, b2 - a2 * b0])  # input to state
        powers = [np.eye(2)]
        for _ in range(size):
            powers.append(step @ powers[-1])
        powers = np.array(powers)
        impulse = np.concatenate(([b0], powers[: size - 1, 0] @ push))
        lag = np.arange(size)[:, None] - np.arange(size)
        out_in = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
        _CACHE[section, size] = out_in, powers[:size, 0], (powers[size - 1 :: -1] @ push).T, powers[size]
    return _CACHE[section, size]


def sosfilt_from(sections: tuple[Section, ...], x: np.ndarray, states: np.ndarray | None = None, size: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The sections one after the other over the last axis of a matrix (rows by samples), from given states.

    `states` has two numbers per section and row (sections by rows by 2; none: zero). Returns the
    output and the states after the last sample, with which the next samples go on.
    """
    y = np.array(x, np.float64, ndmin=2)
    rows, n = y.shape
    states = np.zeros((len(sections), rows, 2)) if states is None else np.array(states, np.float64)
    whole = n // size * size
    for k, section in enumerate(sections):
        b0, b1, b2, a1, a2 = section
        state = states[k]
        if whole:
            out_in, out_state, state_in, through = _blocks(section, size)
            blocks = y[:, :whole].reshape(rows, -1, size)
            fresh = blocks @ state_in.T  # what each block adds to the state
            at = np.zeros((blocks.shape[1], rows, 2))
            for i in range(blocks.shape[1]):
                at[i] = state
                state = state @ through.T + fresh[:, i]
            done = (blocks @ out_in.T + at.transpose(1, 0, 2) @ out_state.T).reshape(rows, whole)
            y = np.concatenate((done, y[:, whole:]), 1)
        z0, z1 = state[:, 0], state[:, 1]
        for i in range(whole, n):  # fewer than a block
            v = y[:, i].copy()
            w = b0 * v + z0
            z0, z1 = b1 * v - a1 * w + z1, b2 * v - a2 * w
            y[:, i] = w
        states[k] = np.stack((z0, z1), 1)
    return y, states


def sosfilt(sections: tuple[Section, ...], x: np.ndarray) -> np.ndarray:
    """The sections over the last axis of a matrix, from a zero state."""
    return sosfilt_from(sections, x)[0]


def filtfilt(sections: tuple[Section, ...], x: np.ndarray) -> np.ndarray:
    """Forward and backward from zero states, without padding: no phase shift away from the ends."""
    once = sosfilt(sections, x)
    return sosfilt(sections, once[:, ::-1])[:, ::-1]


def where_there(of: Callable[..., np.ndarray], x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """`of(x, *more)` for each group of rows of `x` that lack the same samples (NaN), as if those places were not there."""
    gone = np.isnan(x)
    if not gone.any():
        return of(x, *more)
    y = np.full_like(x, np.nan)
    patterns, which = np.unique(gone, axis=0, return_inverse=True)
    for i, lost in enumerate(patterns):
        if not lost.all():
            own = np.flatnonzero(which.ravel() == i)
            at = np.ix_(own, np.flatnonzero(~lost))
            y[at] = of(x[at], *(m[own] for m in more))
    return y


@lru_cache(64)
def kfilt_matrix(n_rows: int, wn: float = KFILT_WN, pad: int = KFILT_PAD) -> np.ndarray:
    """The spatial filter of `n_rows` rows as one matrix: mirror, filter across rows, crop.

    All of that is linear, so column j is what a unit in row j becomes.
    """
    pad = min(pad, n_rows)
    inside = np.arange(n_rows)
    above = np.minimum(np.arange(pad)[::-1], n_rows - 1)
    below = np.maximum(n_rows - 1 - np.arange(pad), 0)
    columns = np.eye(n_rows)[np.concatenate((above, inside, below))]
    filtered = filtfilt(butter_highpass(FILTER_ORDER, wn), columns.T).T
    return filtered[pad : pad + n_rows]
