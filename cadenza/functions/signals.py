"""What one recording becomes: conditioned signals, repetitions and their features. Numpy on one set's arrays; each step
follows the order in the public method description and is called from grouped functions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import kernels as K

FS = 100.0
GAP_S = 0.050
STILL_ACC, STILL_GYRO, STILL_S = 3.0, 0.6, 0.10
BRIDGE_S, LEAST_ACTIVE_S, EDGE_PAD_S, KEEP = 6.0, 5.0, 1.5, 0.5
RHYTHM_TOLERANCE, LEAST_GAPS, MERGE_CADENCES, EVIDENCE = 0.45, 3, 3.5, 0.85
RECOVERY = 0.6
REJECT, REJECT_LEAST = 6.0, 5


@dataclass
class Conditioned:
    """Signals of one set on the uniform grid."""

    t: np.ndarray
    a_vert: np.ndarray
    a_horiz: np.ndarray
    a_world: np.ndarray
    v_vert: np.ndarray
    v_horiz: np.ndarray
    d_vert: np.ndarray
    d_horiz: np.ndarray
    tremor: np.ndarray
    still: np.ndarray
    runs: list[tuple[int, int]]
    anchors: np.ndarray
    flags: list[str]


def runs_of(mask: np.ndarray, least: int = 1) -> list[tuple[int, int]]:
    """First and last place of each run of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(int)))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= least]


def integral(x: np.ndarray, fs: float = FS) -> np.ndarray:
    out = np.zeros_like(x)
    out[1:] = np.cumsum((x[1:] + x[:-1]) / 2, axis=0) / fs
    return out


def to_world(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    once = np.cross(q[:, 1:], v)
    return v + 2 * (q[:, :1] * once + np.cross(q[:, 1:], once))


def condition(t_ns: np.ndarray, channels: np.ndarray, reported_reps: int | None = None, fs: float = FS) -> Conditioned:
    """``channels``: acceleration, rotation rate, quaternion, gravity, 13 columns in the contract's order."""
    t = (t_ns - t_ns[0]) / 1e9
    grid = np.arange(int(np.floor(t[-1] * fs)) + 1) / fs
    x = np.stack([np.interp(grid, t, c) for c in channels.T], 1)
    q = x[:, 6:10]
    size = np.linalg.norm(q, axis=1, keepdims=True)
    q = q / np.where(size > 0, size, 1)
    acc, gravity, gyro = to_world(q, x[:, :3]), to_world(q, x[:, 10:13]), x[:, 3:6]
    up = -K.lowpass(gravity, fs, 0.3, 2).mean(0)
    up = up / np.linalg.norm(up) if np.linalg.norm(up) > 0 else np.array([0.0, 0.0, 1.0])
    side = np.cross(up, [1.0, 0, 0] if abs(up[0]) < 0.9 else [0, 1.0, 0])
    side /= np.linalg.norm(side)
    side = np.cross(side, up)
    plane = np.stack([side, np.cross(up, side)], 1)
    a_vert, a_horiz, a_world = K.lowpass(acc @ up, fs), K.lowpass(acc @ plane, fs), K.lowpass(acc, fs)
    tremor = np.abs(K.bandpass(np.linalg.norm(gyro, axis=1), fs))
    slow = np.linalg.norm(K.lowpass(acc, fs, 3.0, 2), axis=1), np.linalg.norm(K.lowpass(gyro, fs, 3.0, 2), axis=1)
    still = runs_of((slow[0] < STILL_ACC) & (slow[1] < STILL_GYRO), max(round(STILL_S * fs), 1))
    mask = np.zeros(len(grid), bool)
    for a, b in still:
        mask[a : b + 1] = True
    anchors = np.array([(a + b) // 2 for a, b in still], int)

    def anchored(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = integral(a, fs)
        if len(anchors):
            drift = np.stack([np.interp(np.arange(len(v)), anchors, c[anchors]) for c in np.atleast_2d(v.T)], -1)
            v = v - (drift if v.ndim > 1 else drift[:, 0])
        return v, K.highpass(integral(v, fs), fs)

    v_vert, d_vert = anchored(a_vert)
    v_horiz, d_horiz = anchored(a_horiz)
    flags = ["sample_gaps"] if (np.diff(t) > GAP_S).any() else []
    if not len(anchors):
        flags.append("no_stationary_anchors")
    elif reported_reps is not None and len(anchors) < reported_reps:
        flags.append("insufficient_stationary")
    return Conditioned(grid, a_vert, a_horiz, a_world, v_vert, v_horiz, d_vert, d_horiz, tremor, mask, still, anchors, flags)


def rolling_rms(x: np.ndarray, size: int) -> np.ndarray:
    pad = size // 2
    wide = np.pad(x * x, pad, mode="edge")
    total = np.concatenate([[0.0], np.cumsum(wide)])
    return np.sqrt(np.maximum(total[size:] - total[:-size], 0) / size)[: len(x)]


def active_window(c: Conditioned, fs: float = FS) -> tuple[int, int, float]:
    """First and last place of the working part and its share; the whole recording where nothing tells it apart."""
    n = len(c.t)
    if n < 3:
        return 0, max(n - 1, 0), 1.0
    if found := _rhythm(c.d_vert, fs):
        return *found, (found[1] - found[0] + 1) / n
    energy = rolling_rms(np.linalg.norm(c.a_world, axis=1), int(fs))
    low, high = np.percentile(energy, [10, 90])
    if high - low < 1e-9:
        return 0, n - 1, 1.0
    merged: list[list[int]] = []
    for a, b in runs_of(energy >= low + 0.35 * (high - low)):
        if merged and a - merged[-1][1] <= int(BRIDGE_S * fs):
            merged[-1][1] = b
        else:
            merged.append([a, b])
    if not merged:
        return 0, n - 1, 1.0
    long = [r for r in merged if r[1] - r[0] >= int(LEAST_ACTIVE_S * fs)] or merged
    a, b = max(long, key=lambda r: r[1] - r[0])
    pad = int(EDGE_PAD_S * fs)
    a, b = max(0, a - pad), min(n - 1, b + pad)
    share = (b - a + 1) / n
    return (a, b, share) if share >= KEEP else (0, n - 1, share)


def _rhythm(d: np.ndarray, fs: float) -> tuple[int, int] | None:
    low, high = np.percentile(d, [5, 95])
    if high <= low:
        return None
    bottoms = K.find_peaks(-d, distance=max(int(0.4 * fs), 1), prominence=0.2 * (high - low))
    if len(bottoms) <= LEAST_GAPS:
        return None
    gaps = np.diff(bottoms).astype(float)
    cadence = float(np.median(gaps))
    if cadence <= 0:
        return None
    merged: list[list[int]] = []
    for a, b in runs_of(np.abs(gaps - cadence) / cadence <= RHYTHM_TOLERANCE, LEAST_GAPS):
        first, last = int(bottoms[a]), int(bottoms[b + 1])
        if merged and first - merged[-1][1] <= MERGE_CADENCES * cadence:
            merged[-1][1] = last
        else:
            merged.append([first, last])
    if not merged:
        return None
    a, b = max(merged, key=lambda r: r[1] - r[0])
    a, b = max(0, a - int(cadence)), min(len(d) - 1, b + int(cadence))
    return (a, b) if (b - a + 1) / len(d) < EVIDENCE else None


def refined(period: float | None, bottoms: np.ndarray, fs: float) -> float | None:
    """The autocorrelation's period checked against the bottoms' own spacing."""
    if len(bottoms) < 3 or (seen := float(np.median(np.diff(bottoms)))) <= 0:
        return period
    if period is None:
        return seen if 0.3 * fs <= seen <= 10 * fs else None
    return period if max(period, seen) <= 2 * min(period, seen) else seen


def segment(c: Conditioned, exercise: str, reached_failure: bool, trim: bool = True, fs: float = FS) -> list[dict]:
    """Repetitions: places of start, bottom and end, whether completed, range and recovery."""
    shift, last, _ = active_window(c, fs) if trim else (0, len(c.t) - 1, 1.0)
    d = c.d_vert[shift : last + 1]
    if len(d) < 3:
        shift, d = 0, c.d_vert
    if len(d) < 3:
        return []
    low, high = np.percentile(d, [5, 95])
    if high <= low:
        return []

    def bottoms_of(period: float | None) -> np.ndarray:
        return K.find_peaks(-d, distance=max(int(0.5 * period), 1) if period else int(0.4 * fs), prominence=0.2 * (high - low))

    period = K.period(d, fs)
    bottoms = bottoms_of(period)
    better = refined(period, bottoms, fs)
    if better is not None and abs(better - (period or 0)) > 1e-6:
        bottoms = bottoms_of(better)
    reps = []
    for k, b in enumerate(bottoms):
        left, right = (bottoms[k - 1] if k else 0), (bottoms[k + 1] if k + 1 < len(bottoms) else len(d) - 1)
        s, e = left + int(np.argmax(d[left : b + 1])), b + int(np.argmax(d[b : right + 1]))
        depth = d[s] - d[b]
        recovery = float((d[e] - d[b]) / depth) if depth > 1e-9 else 0.0
        first, second = (e, s) if exercise == "deadlift" else (s, e)
        reps.append({"i_start": int(first) + shift, "i_bottom": int(b) + shift, "i_end": int(second) + shift, "completed": recovery >= RECOVERY, "rom_vertical": float(max(d[s], d[e]) - d[b]), "recovery": recovery})
    reps = _without_strangers(c, reps)
    if reached_failure and reps and all(r["completed"] for r in reps):
        min(reps, key=lambda r: r["recovery"])["completed"] = False
    for k, r in enumerate(reps, 1):
        r |= {"rep_index": k, "t_start": float(c.t[r["i_start"]]), "t_bottom": float(c.t[r["i_bottom"]]), "t_end": float(c.t[r["i_end"]])}
    return reps


def profile(c: Conditioned, r: dict) -> np.ndarray:
    """Vertical velocity over the repetition on 64 points, largest magnitude 1."""
    a, b = sorted((r["i_start"], r["i_end"]))
    return K.unit_profile(c.v_vert[a : b + 1])


def _without_strangers(c: Conditioned, reps: list[dict]) -> list[dict]:
    done = [r for r in reps if r["completed"]]
    if len(reps) < REJECT_LEAST or len(done) < 2:
        return reps
    model = np.mean([profile(c, r) for r in done[:3]], axis=0)
    far = K.dtw(np.stack([profile(c, r) for r in reps]), np.tile(model, (len(reps), 1)))
    middle = float(np.median(far[np.isfinite(far)])) if np.isfinite(far).any() else 0.0
    kept = [r for r, x in zip(reps, far, strict=True) if not r["completed"] or not np.isfinite(x) or x <= REJECT * middle]
    return kept if middle > 0 and len(kept) >= REJECT_LEAST else reps


def sticking_point(v: np.ndarray, d: np.ndarray, rom: float) -> tuple[float | None, float | None]:
    """Where in the range, from 0 to 1, the upward velocity dips, and its value there; None without a real dip."""
    speed = np.abs(v)
    if not len(speed) or speed.max() <= 0 or rom <= 1e-9:
        return None, None
    moving = np.flatnonzero(speed >= 0.1 * speed.max())
    if moving[-1] - moving[0] < 5:
        return None, None
    a, b = moving[0], moving[-1]
    cut = int(0.2 * (b - a))
    inner = speed[a + cut : b - cut + 1]
    if len(inner) < 3:
        return None, None
    k = int(np.argmin(inner))
    at = a + cut + k
    if k in (0, len(inner) - 1):
        return None, None
    rise = min(speed[a : at + 1].max(), speed[at : b + 1].max()) - speed[at]
    if rise < 0.02 * speed.max():
        return None, None
    return float(np.clip((d[at] - d[0]) / rom, 0, 1)), float(speed[at])


def rep_features(c: Conditioned, reps: list[dict], fs: float = FS) -> list[dict]:
    """The features of each repetition; path_dtw_baseline comes later, from the baseline."""
    out = []
    for r in reps:
        s, b, e = r["i_start"], r["i_bottom"], r["i_end"]
        lo, hi = min(s, e), max(s, e)
        up, down = slice(min(b, e), max(b, e) + 1), slice(min(s, b), max(s, b) + 1)
        v, d = c.v_vert[up], c.d_vert[up]
        whole = slice(lo, hi + 1)
        jerk = np.diff(c.a_world[whole], axis=0) * fs
        path = np.concatenate([c.d_horiz[whole], c.d_vert[whole, None]], 1)
        ecc, conc = abs(r["t_bottom"] - r["t_start"]), abs(r["t_end"] - r["t_bottom"])
        rom = float(c.d_vert[whole].max() - c.d_vert[whole].min())
        arc = float(np.linalg.norm(np.diff(path, axis=0), axis=1).sum()) if hi > lo else 0.0
        stick = sticking_point(v, d, rom)
        pause = next(((y - x + 1) / fs for x, y in c.runs if x <= b <= y), 0.0)
        out.append(
            {
                "conc_mean_vel": float(np.abs(v).mean()),
                "conc_peak_vel": float(np.abs(v).max()),
                "ecc_mean_vel": float(np.abs(c.v_vert[down]).mean()),
                "rom_vertical": rom,
                "ecc_duration": ecc,
                "conc_duration": conc,
                "bottom_pause": float(pause),
                "tempo_ratio": ecc / conc if conc > 1e-9 else 0.0,
                "jerk_rms": float(np.sqrt((jerk**2).sum(1).mean())) if len(jerk) else 0.0,
                "sparc": K.sparc(np.abs(c.v_vert[whole]), fs),
                "tremor_power_8_12": float((c.tremor[whole] ** 2).mean()) if hi > lo else 0.0,
                "path_length": arc,
                "horiz_excursion": float(np.linalg.norm(c.d_horiz[whole] - c.d_horiz[lo], axis=1).max()) if hi > lo else 0.0,
                "path_efficiency": arc / rom if rom > 1e-9 else 0.0,
                "min_vel_position": stick[0],
                "min_vel_value": stick[1],
                "profile": profile(c, r).tolist(),
            }
        )
    return out
