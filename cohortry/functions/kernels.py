"""Numpy kernels on a batch of equally long epochs (rows x samples)."""

from __future__ import annotations

import numpy as np

# Daubechies-4 decomposition low-pass filter.
DB4_LOW = np.array(
    [
        -0.010597401784997278,
        0.032883011666982945,
        0.030841381835986965,
        -0.18703481171888114,
        -0.02798376941698385,
        0.6308807679295904,
        0.7148465705525415,
        0.23037781330885523,
    ]
)
DB4_HIGH = DB4_LOW[::-1] * np.where(np.arange(8) % 2 == 0, -1.0, 1.0)


def welch(x: np.ndarray, fs: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density: Hann segments, half overlap, mean removed per segment."""
    nperseg = min(nperseg, x.shape[1])
    step = max(1, nperseg - nperseg // 2)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    starts = range(0, x.shape[1] - nperseg + 1, step)
    total = 0.0
    for s in starts:
        seg = x[:, s : s + nperseg]
        spec = np.fft.rfft((seg - seg.mean(axis=1, keepdims=True)) * window, axis=1)
        total = total + np.abs(spec) ** 2
    p = total / len(starts) / (fs * (window**2).sum())
    p[:, 1 : None if nperseg % 2 else -1] *= 2
    return np.fft.rfftfreq(nperseg, 1 / fs), p


def band_energy(x: np.ndarray, fs: float, bands: list[tuple[float, float]]) -> np.ndarray:
    """Energy of the signal restricted to each band [low, high) of its spectrum."""
    n = x.shape[1]
    spec = np.abs(np.fft.rfft(x, axis=1)) ** 2 / n
    spec[:, 1 : None if n % 2 else -1] *= 2
    f = np.fft.rfftfreq(n, 1 / fs)
    return np.stack([spec[:, (f >= lo) & (f < hi)].sum(axis=1) for lo, hi in bands], axis=1)


def wavelet_levels(x: np.ndarray, max_level: int = 6) -> list[np.ndarray]:
    """[approximation, coarsest detail, ..., finest detail], symmetric edges."""
    level = min(max_level, int(np.floor(np.log2(max(x.shape[1] / (len(DB4_LOW) - 1), 1)))))
    details, a = [], x
    for _ in range(level):
        pad = np.pad(a, ((0, 0), (7, 7)), mode="symmetric")
        windows = np.lib.stride_tricks.sliding_window_view(pad, 8, axis=1)[:, 1::2]
        details.append(windows @ DB4_HIGH[::-1])
        a = windows @ DB4_LOW[::-1]
    return [a, *details[::-1]]


def wavelet_energy(x: np.ndarray) -> np.ndarray:
    """Energy of each detail level, coarsest first."""
    return np.stack([(d * d).sum(axis=1) for d in wavelet_levels(x)[1:]], axis=1)


def teager_kaiser(x: np.ndarray) -> np.ndarray:
    """Mean and sd of the Teager-Kaiser energy of each wavelet level."""
    out = []
    for c in wavelet_levels(x):
        e = c[:, 1:-1] ** 2 - c[:, 2:] * c[:, :-2]
        out += [e.mean(axis=1), e.std(axis=1)]
    return np.stack(out, axis=1)


def decorrelation(x: np.ndarray, fs: float, level: float) -> np.ndarray:
    """First lag in seconds with autocorrelation below ``level``; NaN if none."""
    n = x.shape[1]
    c = x - x.mean(axis=1, keepdims=True)
    spec = np.fft.rfft(c, 2 * n, axis=1)
    acf = np.fft.irfft(np.abs(spec) ** 2, 2 * n, axis=1)[:, :n]
    flat = acf[:, 0] <= 0
    r = acf / np.where(flat, 1.0, acf[:, 0])[:, None]
    below = r < level
    out = below.argmax(axis=1) / fs
    return np.where(flat | ~below.any(axis=1), np.nan, out)


def higuchi(x: np.ndarray, kmax: int) -> np.ndarray:
    """Slope of log curve length against log(1/k), k = 1..kmax."""
    n = x.shape[1]
    lengths = []
    for k in range(1, kmax + 1):
        per = []
        for m in range(k):
            steps = (n - 1 - m) // k
            d = np.abs(np.diff(x[:, m : m + steps * k + 1 : k], axis=1)).sum(axis=1)
            per.append(d * (n - 1) / (steps * k) / k)
        lengths.append(np.mean(per, axis=0))
    y = np.log(np.where(np.array(lengths) > 0, lengths, np.nan))
    t = np.log(1.0 / np.arange(1, kmax + 1))[:, None]
    return ((t - t.mean()) * (y - y.mean(axis=0))).sum(axis=0) / ((t - t.mean()) ** 2).sum()


def hurst(x: np.ndarray) -> np.ndarray:
    """Slope of log rescaled range against log window size (powers of two from 8)."""
    n = x.shape[1]
    sizes = [s for s in (2**k for k in range(3, 32)) if s <= n]
    logs = []
    for s in sizes:
        seg = x[:, : n // s * s].reshape(len(x), -1, s)
        dev = np.cumsum(seg - seg.mean(axis=2, keepdims=True), axis=2)
        spread, sd = dev.max(axis=2) - dev.min(axis=2), seg.std(axis=2)
        rs = np.where(sd > 0, spread / np.where(sd > 0, sd, 1.0), np.nan)
        with np.errstate(all="ignore"):
            logs.append(np.log(np.nanmean(rs, axis=1)))
    y, t = np.array(logs), np.log(sizes)[:, None]
    return ((t - t.mean()) * (y - y.mean(axis=0))).sum(axis=0) / ((t - t.mean()) ** 2).sum()


def embed(x: np.ndarray, dim: int, tau: int) -> np.ndarray:
    """Delay vectors: rows x vectors x dim."""
    n = x.shape[1] - (dim - 1) * tau
    return np.stack([x[:, i * tau : i * tau + n] for i in range(dim)], axis=2)


def _neighbours(v: np.ndarray, tol: np.ndarray) -> np.ndarray:
    """Vectors within Chebyshev distance ``tol`` of each vector, itself included."""
    near = np.ones((v.shape[0], v.shape[1], v.shape[1]), dtype=bool)
    for d in range(v.shape[2]):
        near &= np.abs(v[:, :, None, d] - v[:, None, :, d]) <= tol[:, None, None]
    return near.sum(axis=2)


def sample_entropy(x: np.ndarray, emb: int = 2) -> np.ndarray:
    tol = 0.2 * x.std(axis=1, ddof=1)
    a = _neighbours(embed(x, emb, 1)[:, :-1], tol) - 1
    b = _neighbours(embed(x, emb + 1, 1), tol) - 1
    with np.errstate(all="ignore"):
        out = -np.log(b.mean(axis=1) / a.mean(axis=1))
    return np.where(np.isfinite(out), out, np.nan)


def approximate_entropy(x: np.ndarray, emb: int = 2) -> np.ndarray:
    tol = 0.2 * x.std(axis=1, ddof=1)
    phi = []
    for m in (emb, emb + 1):
        v = embed(x, m, 1)
        phi.append(np.log(_neighbours(v, tol) / v.shape[1]).mean(axis=1))
    return phi[0] - phi[1]


def svd_measures(x: np.ndarray, tau: int = 2, emb: int = 10) -> np.ndarray:
    """Entropy (bits) and Fisher information of the normalised singular values."""
    s = np.linalg.svd(embed(x, emb, tau), compute_uv=False)
    total = s.sum(axis=1, keepdims=True)
    p = s / np.where(total > 0, total, np.nan)
    with np.errstate(all="ignore"):
        entropy = -np.where(p > 0, p * np.log2(p), 0.0).sum(axis=1)
        fisher = (np.diff(p, axis=1) ** 2 / np.where(p[:, :-1] > 0, p[:, :-1], np.nan)).sum(axis=1)
    return np.stack([np.where(np.isnan(total[:, 0]), np.nan, entropy), fisher], axis=1)


def lempel_ziv(seq: np.ndarray) -> float:
    """LZ76 phrase count scaled by log2(n) / n."""
    n = len(seq)
    text = "".join(chr(65 + int(s)) for s in seq)
    count, i = 0, 0
    while i < n:
        size = 1
        while i + size <= n and text[i : i + size] in text[: i + size - 1]:
            size += 1
        count += 1
        i += size
    return count * np.log2(n) / n
