"""Made waveforms with known arrivals, for the tests of the array kernels."""

from __future__ import annotations

import zlib

import numpy as np

FS = 50.0


def wavelets(det_id: int, sta: str, tp: float, ts: float, n: int) -> np.ndarray:
    """``[3, n]`` samples of noise with P at sample ``tp`` (vertical) and S at ``ts`` (horizontal); the shape depends on the station."""
    noise = np.random.default_rng([det_id & 0xFFFFFFFF, zlib.crc32(sta.encode())]).normal(size=(3, n))
    shape = np.random.default_rng(zlib.crc32(sta.encode()))
    t = np.arange(n)
    for at, channels, size, hz in ((tp, (2,), 30.0, 6.0), (ts, (0, 1), 60.0, 4.0)):
        for k in channels:
            freq, phase = hz * shape.uniform(0.8, 1.25), shape.uniform(0, 2 * np.pi)
            d = np.maximum(t - at, 0) / FS
            noise[k] += (t >= at) * size * np.exp(-1.5 * d) * np.sin(2 * np.pi * freq * d + phase)
    return noise.astype("f4")
