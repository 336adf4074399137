"""Filters against a scalar model and known constants."""

import numpy as np
import pytest

from tracewell.functions.filters import butter_highpass, filtfilt, kfilt_matrix, sosfilt, sosfilt_from


def scalar(sections, x):
    out = list(map(float, x))
    for b0, b1, b2, a1, a2 in sections:
        z0 = z1 = 0.0
        for i, v in enumerate(out):
            y = b0 * v + z0
            z0, z1 = b1 * v - a1 * y + z1, b2 * v - a2 * y
            out[i] = y
    return np.array(out)


def test_golden_sections():
    pair, single = butter_highpass(3, 0.02)
    assert np.allclose(pair, [0.968603796, -1.937207593, 0.968603796, -1.935294387, 0.939120799], atol=1e-9)
    assert np.allclose(single, [0.969531253, -0.969531253, 0, -0.939062506, 0], atol=1e-9)
    pair, single = butter_highpass(3, 0.01)
    assert np.allclose(pair, [0.984294561, -1.968589121, 0.984294561, -1.968103311, 0.969074931], atol=1e-9)
    assert np.allclose(single, [0.984533709, -0.984533709, 0, -0.969067417, 0], atol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_response(order):
    sections, w = butter_highpass(order, 0.3), np.array([1e-9, 0.3 * np.pi, np.pi])
    z = np.exp(-1j * w)
    h = np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections], axis=0)
    assert np.allclose(np.abs(h), [0, np.sqrt(0.5), 1], atol=1e-6)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000])
def test_blocks_equal_recursion(n):
    x = np.random.default_rng(n).normal(size=(3, n))
    for sections in (butter_highpass(3, 0.02), butter_highpass(4, 0.6)):
        assert np.allclose(sosfilt(sections, x), [scalar(sections, r) for r in x], atol=1e-10)
        assert np.allclose(filtfilt(sections, x), [scalar(sections, scalar(sections, r)[::-1])[::-1] for r in x], atol=1e-10)


def test_states_carry_over():
    sections, x = butter_highpass(3, 0.1), np.random.default_rng(5).normal(size=(2, 500))
    states, parts = None, []
    for lo, hi in ((0, 3), (3, 130), (130, 130), (130, 500)):
        y, states = sosfilt_from(sections, x[:, lo:hi], states)
        parts.append(y)
    assert np.allclose(np.concatenate(parts, 1), sosfilt(sections, x), atol=1e-10)


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_kfilt_matrix_equals_mirror_filter_crop(n):
    x, pad = np.random.default_rng(n).normal(size=n), min(60, n)
    mirrored = np.concatenate((x[:pad][::-1], x, x[::-1][:pad]))
    want = filtfilt(butter_highpass(3, 0.01), mirrored[None])[0][pad : pad + n]
    assert np.allclose(kfilt_matrix(n) @ x, want, atol=1e-9)


def test_bad_cutoff():
    with pytest.raises(ValueError):
        butter_highpass(3, 1.0)
