"""Array kernels on one station's samples (numpy, no Spark). Windows are in samples unless they end in ``_s``."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def finite(x: np.ndarray) -> np.ndarray:
    return np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)


def window_sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``n`` successive values, one per start."""
    total = np.concatenate([[0.0], np.cumsum(x, dtype="f8")])
    return total[n:] - total[:-n]


def sta_lta(x: np.ndarray, short: int, long: int) -> np.ndarray:
    """Mean of the ``short`` values after each sample over the mean of the ``long`` values up to it.

    The first ``long`` and the last ``short`` values are 0, and so is any ratio that is not finite; input shorter than
    both windows gives a single 0.
    """
    if len(x) < short + long:
        return np.zeros(1)
    out = np.zeros(len(x))
    lta = window_sums(x, long)[1:] / long  # ends at sample ``long`` and later
    sta = window_sums(x, short)[long + 1 :] / short  # starts one sample after
    with np.errstate(divide="ignore", invalid="ignore"):
        out[long : len(x) - short] = finite(sta / lta[: len(sta)])
    return out


def sliding_kurtosis(x: np.ndarray, n: int) -> np.ndarray:
    """Excess kurtosis (population form) of the ``n`` values from each start on, the last window left out; 0 where all are equal."""
    if len(x) <= n:
        return np.zeros(1)
    w = sliding_window_view(x, n)[: len(x) - n]
    d = w - w.mean(axis=1, keepdims=True)
    var = (d * d).mean(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return finite((d**4).mean(axis=1) / var**2 - 3.0)


def polarization(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rectilinearity and main direction of windows ``[k, 3, n]``."""
    d = x - x.mean(axis=2, keepdims=True)
    value, vector = np.linalg.eigh(d @ d.transpose(0, 2, 1) / max(1, x.shape[2] - 1))
    main = np.maximum(value[:, 2], 1e-300)
    return 1.0 - 0.5 * (value[:, 0] + value[:, 1]) / main, vector[:, :, 2]


def pca_filter(data: np.ndarray, tp: int, reach: tuple[int, int], n: int) -> np.ndarray:
    """Weights that lessen motion in the direction of P from ``tp - reach[0]`` to ``tp + reach[1]``."""
    _, p = polarization(data[None, :, tp : tp + n])
    lo, hi = max(0, tp - reach[0]), min(data.shape[1], tp + reach[1] + n)
    windows = sliding_window_view(data[:, lo:hi], n, axis=1).transpose(1, 0, 2)[: max(0, hi - lo - n)]
    if not len(windows):
        return np.ones(0)
    rate, main = polarization(windows)
    return 1.0 - rate * np.abs(main @ p[0])


def turning_index(x: np.ndarray, which: int) -> int:
    """Index of the first (1) or second (2) turning point of a series; 0 for a series that never falls or never rises.

    The first is the first step whose direction (down, or not) differs from that of step 0. The second is where, after the first,
    both directions have been seen; where they never are, it is the first.
    """
    step = np.diff(x)
    if not (step < 0).any() or not (step > 0).any():
        return 0
    down = step < 0
    first = int(np.argmax(down != down[0]))
    later = down[first + 1 :]
    if which == 1 or later.all() or not later.any():
        return first
    return first + 1 + int(np.argmax(later != later[0]))


def trim_pad(x: np.ndarray, first: int, n: int) -> np.ndarray:
    """``n`` samples from sample ``first`` on (which may lie before the start); samples that the series does not have are 0."""
    out = np.zeros(n, x.dtype)
    lo, hi = max(0, first), min(len(x), first + n)
    if lo < hi:
        out[lo - first : hi - first] = x[lo:hi]
    return out


def displacement_amplitude(velocity: np.ndarray, fs: float) -> float:
    """Greatest length of the displacement vector of demeaned velocities ``[channel, n]``."""
    if velocity.shape[1] == 0:
        return float("nan")
    moved = np.cumsum(velocity - velocity.mean(axis=1, keepdims=True), axis=1) / fs
    return float(np.sqrt((moved**2).sum(axis=0).max()))


def dominant_frequency(x: np.ndarray, fs: float) -> float:
    if len(x) < 2:
        return 0.0
    power = np.abs(np.fft.rfft(x - x.mean()))[: max(1, len(x) // 2)] ** 2
    return float(np.argmax(power) * fs / len(x))


def peak_ratio(data: np.ndarray, n: int) -> np.ndarray:
    """Per channel the greatest absolute value over the greatest one outside the ``n`` samples around it."""
    out = []
    for x in np.abs(data):
        at = int(np.argmax(x)) if len(x) else 0
        rest = np.concatenate([x[: max(0, at - n // 2)], x[at + n // 2 :]])
        out.append(x[at] / rest.max() if len(rest) and rest.max() > 0 else np.inf)
    return np.array(out)


def rolling_norm(x: np.ndarray, n: int) -> np.ndarray:
    """``out[i]``: the norm of the ``n`` values after sample ``i``."""
    return np.sqrt(np.maximum(window_sums(x.astype("f8") ** 2, n)[1:], 0))


def correlate(data: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised correlation; value ``k`` belongs to the window from sample ``k + 1`` on. Values that are not finite are 0.

    Data without such a window, because they are not longer than the template, give a single 0.
    """
    n = len(template)
    if n >= len(data):
        return np.zeros(1)
    size = 1 << int(np.ceil(np.log2(len(data) + n)))
    full = np.fft.irfft(np.fft.rfft(data, size) * np.conj(np.fft.rfft(template, size)), size)
    scale = rolling_norm(data, n) * np.sqrt((template.astype("f8") ** 2).sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        return finite(np.where(scale > 1e-12, full[1 : len(data) - n + 1] / scale, 0.0))


def demean_detrend_taper(x: np.ndarray, fs: float, share: float = 0.05, longest_s: float = 5.0) -> np.ndarray:
    """Without mean and straight trend, its ends tapered by a Hann flank of ``share`` of the length, at most ``longest_s``."""
    n = len(x)
    if n < 2:
        return np.zeros(n)
    t = np.arange(n) - (n - 1) / 2
    y = x - x.mean()
    y = y - t * (t @ y) / (t @ t)
    flank = min(int(share * n), int(longest_s * fs))
    if flank > 0:
        rise = 0.5 * (1 - np.cos(np.pi * np.arange(flank) / flank))
        y[:flank] *= rise
        y[-flank:] *= rise[::-1]
    return y


def prepare_match(data: np.ndarray, fs: float, new_fs: float, low: float | None = 1.0, high: float | None = 20.0) -> np.ndarray:
    """Channels ready for matching: tapered, resampled, values finite, filtered. Nothing is repaired."""
    rows = [resample(demean_detrend_taper(finite(np.asarray(x, "f8")), fs), fs, new_fs) for x in data]
    return np.stack([bandpass(finite(x), new_fs, low, high) for x in rows])


def _butterworth(f: np.ndarray, fs: float, low: float | None, high: float | None, corners: int) -> np.ndarray:
    """Frequency response of a causal Butterworth filter made by the bilinear transform."""
    warp = lambda hz: 2 * fs * np.tan(np.pi * np.minimum(hz, 0.499 * fs) / fs)
    s = 1j * 2 * fs * np.tan(np.pi * np.minimum(f, 0.4999 * fs) / fs)
    if low and high:
        w0, bw = np.sqrt(warp(low) * warp(high)), warp(high) - warp(low)
        p = np.where(s == 0, np.inf, (s * s + w0 * w0) / np.where(s == 0, 1, s * bw))
    elif high:
        p = s / warp(high)
    else:
        p = np.where(s == 0, np.inf, warp(low) / np.where(s == 0, 1, s))
    poles = np.exp(1j * np.pi * (2 * np.arange(1, corners + 1) + corners - 1) / (2 * corners))
    with np.errstate(invalid="ignore", over="ignore"):
        h = 1 / np.prod(p[:, None] - poles[None, :], axis=1)
    return np.where(np.isfinite(h), h, 0)


def bandpass(x: np.ndarray, fs: float, low: float | None, high: float | None, corners: int = 4) -> np.ndarray:
    """Butterworth filter (one pass, causal) by its frequency response; the padding is longer than its ringing."""
    if not low and not high:
        raise ValueError("a corner frequency is needed")
    n = len(x)
    pad = int(20 * fs / (low or high)) + 64
    size = 1 << int(np.ceil(np.log2(n + pad)))
    f = np.fft.rfftfreq(size, 1 / fs)
    return np.fft.irfft(np.fft.rfft(x, size) * _butterworth(f, fs, low, high, corners), size)[:n]


def resample(x: np.ndarray, fs: float, new_fs: float) -> np.ndarray:
    """Fourier resampling."""
    if fs == new_fs or len(x) == 0:
        return x
    n = int(round(len(x) * new_fs / fs))
    spectrum = np.fft.rfft(x)
    return np.fft.irfft(np.resize(np.pad(spectrum, (0, max(0, n // 2 + 1 - len(spectrum)))), n // 2 + 1), n) * n / len(x)


def gaps(x: np.ndarray, least: int = 3) -> list[tuple[int, int]]:
    """Stretches ``[start, end)`` of samples that repeat the one before, ``least`` steps or more."""
    still = np.concatenate([[False], np.diff(x) == 0, [False]]).astype("i1")
    edge = np.diff(still)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), (ends[keep] + 1).tolist(), strict=True))


def fill_gaps(x: np.ndarray, longest: int, least: int = 3) -> np.ndarray:
    """Gaps filled from the data after them: at most as long as the gap, ``longest``, and the way to the next gap, repeated as needed."""
    out, found = x.copy(), gaps(x, least)
    for k, (a, b) in enumerate(found):
        until = found[k + 1][0] if k + 1 < len(found) else len(x)
        source = x[b : min(until, b + min(b - a, longest))]
        if len(source):
            out[a:b] = np.resize(source, b - a)
    return out


def prepare(data: np.ndarray, fs: float, low: float | None = 1.0, high: float | None = 20.0, longest_gap_s: float = 5.0) -> np.ndarray | None:
    """Three channels ready for the picker: values finite, dead channels replaced, gaps filled, tapered and filtered; None if all are dead."""
    data = finite(np.asarray(data, "f8"))
    alive = [k for k in range(len(data)) if np.any(data[k])]
    if not alive or data.shape[1] < 2:
        return None
    data = np.stack([data[k] if k in alive else data[alive[-1]] for k in range(len(data))])
    rows = [demean_detrend_taper(fill_gaps(x, int(longest_gap_s * fs)), fs) for x in data]
    return np.stack([bandpass(x, fs, low, high) for x in rows])
