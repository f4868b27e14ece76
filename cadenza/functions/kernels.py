"""Numerical kernels for what is sequential by nature: filters, peaks, warping, spectra. Plain numpy, from the public
definitions; they run inside grouped Arrow functions."""

from __future__ import annotations

import math

import numpy as np

PROFILE = 64


def butter_sos(order: int, cut: float | tuple[float, float], fs: float, kind: str) -> np.ndarray:
    """Butterworth sections (b0 b1 b2 1 a1 a2) by the bilinear transform with prewarping; order even."""
    poles = [np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)]
    warp = lambda f: 2 * fs * math.tan(math.pi * f / fs)
    if kind == "low":
        w = warp(cut)
        p, zeros = [w * x for x in poles], [-1.0] * order
    elif kind == "high":
        w = warp(cut)
        p, zeros = [w / x for x in poles], [1.0] * order
    else:
        a, b = warp(cut[0]), warp(cut[1])
        half = [x * (b - a) / 2 for x in poles]
        p = [y for h in half for y in (h + np.sqrt(h * h - a * b + 0j), h - np.sqrt(h * h - a * b + 0j))]
        zeros = [1.0, -1.0] * order
    z = [(2 * fs + x) / (2 * fs - x) for x in p]
    upper = sorted((x for x in z if x.imag > 1e-14), key=lambda x: -abs(x))
    real = sorted((x.real for x in z if abs(x.imag) <= 1e-14), reverse=True)
    pairs = [(-2 * x.real, abs(x) ** 2) for x in upper] + [(-(real[i] + real[i + 1]), real[i] * real[i + 1]) for i in range(0, len(real) - 1, 2)]
    if kind == "band":
        numerators = [(1.0, 0.0, -1.0)] * len(pairs)
        at = np.exp(1j * 2 * math.atan(math.sqrt(math.tan(math.pi * cut[0] / fs) * math.tan(math.pi * cut[1] / fs))))
    else:
        numerators = [(1.0, 2.0, 1.0) if zeros[0] < 0 else (1.0, -2.0, 1.0)] * len(pairs)
        at = 1.0 if kind == "low" else -1.0
    sos = np.array([[*n, 1.0, *d] for n, d in zip(numerators, pairs, strict=True)])
    gain = np.prod([abs((n[0] + n[1] / at + n[2] / at**2) / (1 + d[0] / at + d[1] / at**2)) for n, d in zip(numerators, pairs, strict=True)])
    sos[0, :3] /= gain
    return sos


#: Responses made before, by sections and length; lengths are powers of two, so there are few.
_responses: dict[tuple, np.ndarray] = {}


def _response(sections: tuple[tuple[float, ...], ...], n: int) -> np.ndarray:
    """Impulse response on ``n`` samples."""
    if (sections, n) in _responses:
        return _responses[sections, n]
    out = [1.0] + [0.0] * (n - 1)
    for b0, b1, b2, _, a1, a2 in sections:
        s1 = s2 = 0.0
        for i, v in enumerate(out):
            out[i] = r = b0 * v + s1
            s1, s2 = b1 * v - a1 * r + s2, b2 * v - a2 * r
    _responses[sections, n] = np.array(out)
    return _responses[sections, n]


def _filter(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One pass over the first axis, started in the steady state of the first sample.

    A linear filter is the convolution with its impulse response, here by spectra; the steady state is that of a
    constant first sample, so it acts on the difference to that.
    """
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    h = np.fft.rfft(_response(tuple(map(tuple, sos.tolist())), 1 << (n - 1).bit_length())[:n], size)
    gain = np.prod(sos[:, :3].sum(1) / (1 + sos[:, 4] + sos[:, 5]))
    y = np.fft.irfft(np.fft.rfft(x - x[0], size, axis=0) * (h if x.ndim == 1 else h[:, None]), size, axis=0)[:n]
    return y + x[0] * gain


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over an odd extension of both ends; channels are the columns of ``x``."""
    n = len(sos)
    pad = 3 * (2 * n + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum())))
    x = np.asarray(x, float)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return _filter(sos, _filter(sos, wide)[::-1])[::-1][pad:-pad]


def lowpass(x: np.ndarray, fs: float, cut: float = 10.0, order: int = 4) -> np.ndarray:
    return zero_phase(butter_sos(order, cut, fs, "low"), x) if len(x) > 3 * (2 * order + 1) else np.array(x, float)


def highpass(x: np.ndarray, fs: float, cut: float = 0.15, order: int = 2) -> np.ndarray:
    return zero_phase(butter_sos(order, cut, fs, "high"), x) if len(x) > max(3 * (2 * order + 1), int(2 * fs / cut)) else np.array(x, float)


def bandpass(x: np.ndarray, fs: float, band: tuple[float, float] = (8.0, 12.0), order: int = 4) -> np.ndarray:
    return zero_phase(butter_sos(order, band, fs, "band"), x) if len(x) > 3 * (2 * order + 1) else np.zeros(np.shape(x))


def find_peaks(x: np.ndarray, height: float | None = None, distance: float | None = None, prominence: float | None = None) -> np.ndarray:
    """Places of local maxima, of plateaus the middle; then by height, by distance (higher ones first), by prominence."""
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.empty(0, int)
    change = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    ends = np.r_[change[1:] - 1, len(x) - 1]
    v = x[change]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    found = (change[top] + ends[top]) // 2
    if height is not None:
        found = found[x[found] >= height]
    if distance is not None and len(found):
        reach, keep = math.ceil(distance), np.ones(len(found), bool)
        for k in np.argsort(x[found], kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(found - found[k]) < reach
                near[k] = False
                keep[near] = False
        found = found[keep]
    if prominence is not None:
        found = np.array([p for p in found if _prominence(x, p) >= prominence], int)
    return found


def _prominence(x: np.ndarray, p: int) -> float:
    higher = np.flatnonzero(x > x[p])
    left, right = higher[higher < p], higher[higher > p]
    a, b = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else len(x))
    return float(x[p] - max(x[a : p + 1].min(), x[p:b].min()))


def dtw(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Warping distances of many pairs (rows) at once: least sum of absolute differences over n + m; infinite if empty.

    Cells of an anti-diagonal depend on the two before only, so each is one array operation over all pairs.
    """
    a, b = np.atleast_2d(np.asarray(a, float)), np.atleast_2d(np.asarray(b, float))
    n, m = a.shape[1], b.shape[1]
    if not n or not m:
        return np.full(len(a), np.inf)
    before = np.full((len(a), n + 1), np.inf)
    last = np.full((len(a), n + 1), np.inf)
    before[:, 0] = 0.0  # diagonal 0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        cost = np.abs(a[:, i - 1] - b[:, d - i - 1])
        now = np.full((len(a), n + 1), np.inf)
        now[:, i] = cost + np.minimum(np.minimum(last[:, i - 1], last[:, i]), before[:, i - 1])
        before, last = last, now
    return last[:, n] / (n + m)


def resample_curve(x: np.ndarray, n: int = PROFILE) -> np.ndarray:
    x = np.asarray(x, float)
    return np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(x)), x) if len(x) >= 2 else np.zeros(n)


def unit_profile(x: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The curve on ``n`` points, divided by its largest magnitude if that is above 1e-9."""
    y = resample_curve(x, n)
    peak = np.abs(y).max()
    return y / peak if peak > 1e-9 else y


def sparc(x: np.ndarray, fs: float, top: float = 20.0) -> float:
    """Smoothness: minus the arc length of the normalised magnitude spectrum up to ``top`` Hz; 0 for under 8 samples."""
    x = np.asarray(x, float)
    if len(x) < 8:
        return 0.0
    n = max(4 * 2 ** math.ceil(math.log2(len(x))), 64)
    magnitude = np.abs(np.fft.rfft(x - x.mean(), n))
    f = np.fft.rfftfreq(n, 1 / fs)
    keep = f <= top
    magnitude, f = magnitude[keep], f[keep]
    peak = magnitude.max()
    if peak <= 1e-12 or len(f) < 2:
        return 0.0
    m = magnitude / peak
    width = f[-1] - f[0]
    return float(-np.sum(np.sqrt((np.diff(f) / width) ** 2 + np.diff(m) ** 2)))


def period(x: np.ndarray, fs: float, least: float = 0.3, most: float = 10.0, height: float = 0.2) -> float | None:
    """Samples per cycle: the first autocorrelation peak between the two lags, or None."""
    x = np.asarray(x, float) - np.mean(x)
    lo, hi = int(least * fs), min(int(most * fs), len(x) - 2)
    if hi <= lo:
        return None
    n = 1 << (2 * len(x) - 1).bit_length()
    spectrum = np.fft.rfft(x, n)
    c = np.fft.irfft(spectrum * np.conj(spectrum), n)[: len(x)]
    if c[0] <= 0:
        return None
    found = find_peaks(c[lo : hi + 1] / c[0], height=height)
    return float(found[0] + lo) if len(found) else None
