"""Kernels against their definitions."""

import numpy as np
import pytest

from cadenza.functions import kernels as K

FS = 100.0


def gain(sos, f):
    z = np.exp(2j * np.pi * f / FS)
    return abs(np.prod([(a[0] + a[1] / z + a[2] / z**2) / (1 + a[4] / z + a[5] / z**2) for a in sos]))


@pytest.mark.parametrize(("kind", "cut", "order", "flat"), [("low", 10, 4, 0.01), ("high", 0.15, 2, 50), ("band", (8, 12), 4, 9.8)])
def test_butterworth_gain(kind, cut, order, flat):
    sos = K.butter_sos(order, cut, FS, kind)
    assert gain(sos, flat) == pytest.approx(1, abs=1e-3)
    for f in np.atleast_1d(cut):
        assert gain(sos, f) == pytest.approx(np.sqrt(0.5), abs=1e-6)


def test_zero_phase_keeps_constants_and_direction():
    x = np.random.default_rng(0).normal(size=400)
    assert K.lowpass(np.full(300, 2.5), FS) == pytest.approx(2.5)
    middle = slice(100, 300)
    assert K.lowpass(x[::-1], FS)[::-1][middle] == pytest.approx(K.lowpass(x, FS)[middle], abs=1e-2)
    assert (K.bandpass(np.ones(27), FS) == 0).all()
    assert (K.lowpass(x[:20], FS) == x[:20]).all()


def test_peaks():
    assert K.find_peaks([0, 1, 1, 1, 0, 2, 0]).tolist() == [2, 5]
    assert K.find_peaks([0, 1, 1, 0]).tolist() == [1]
    assert K.find_peaks([0, 3, 0, 2, 0, 5, 0], distance=3).tolist() == [1, 5]
    assert K.find_peaks([0, 3, 2.5, 2.8, 0], prominence=1).tolist() == [1]
    assert K.find_peaks([1, 1, 1]).tolist() == []


def plain_dtw(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1] / (len(a) + len(b))


def test_dtw():
    rng = np.random.default_rng(1)
    a, b = rng.random((5, 9)), rng.random((5, 7))
    assert K.dtw(a, b) == pytest.approx([plain_dtw(x, y) for x, y in zip(a, b, strict=True)])
    assert K.dtw(a, a) == pytest.approx(0)
    assert np.isinf(K.dtw(np.empty((1, 0)), np.ones((1, 3)))).all()


def test_profiles_period_and_smoothness():
    assert K.resample_curve(np.array([1.0])).tolist() == [0.0] * 64
    assert np.abs(K.unit_profile(np.array([0, -4.0, 2]))).max() == pytest.approx(1, abs=0.05)
    t = np.arange(2000) / FS
    assert K.period(np.sin(np.pi * t), FS) == 200
    assert K.period(np.zeros(500), FS) is None
    assert K.sparc(np.ones(5), FS) == 0 and K.sparc(np.sin(t[:200]), FS) <= 0
