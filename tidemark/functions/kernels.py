"""Numeric kernels for one signal or spectrum, on NumPy only; Spark calls them a series at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# fixed values: bands and windows of the analysis
SIGMA_BAND, SLOW_BAND, BASELINE_BAND = (10.0, 16.0), (0.01, 0.1), (0.06, 0.1)
BANDS = {"delta": (0.5, 4), "theta": (4, 8), "alpha": (8, 13), "sigma": (11, 16), "beta": (13, 30), "gamma": (30, 45)}
SAMPLE_RATE, ENVELOPE_RATE, WINDOW_SEC, EPOCH_SEC, MIN_BOUT_SEC, BAND_WINDOW_SEC = 128.0, 1.0, 100.0, 30.0, 200.0, 4.0
SD_BOUNDS, SD_START = (1e-3, 0.05), 0.01


def resample(x: np.ndarray, rate: float, new_rate: float) -> np.ndarray:
    """Fourier resampling to round(n * new / old) samples (half to even)."""
    if rate <= 0 or new_rate <= 0:
        raise ValueError("rates must be positive")
    if rate == new_rate:
        return x
    n = len(x)
    m = round(n / rate * new_rate)
    f = np.fft.rfft(x)
    keep = min(n, m)
    y = np.zeros(m // 2 + 1, complex)
    half = keep // 2 + 1
    y[:half] = f[:half]
    if keep % 2 == 0 and m != n:  # the bin at the smaller rate's half stands for both its signs
        y[keep // 2] *= 2 if m < n else 0.5
    return np.fft.irfft(y, m) * (m / n)


def resample_channels(signals: list[np.ndarray], rates: list[float], new_rate: float) -> np.ndarray:
    """All channels at one rate, cut to the shortest; no channels give an empty array."""
    if not signals:
        return np.zeros((0, 0))
    out = [resample(x, r, new_rate) for x, r in zip(signals, rates, strict=True)]
    n = min(map(len, out))
    return np.stack([x[:n] for x in out])


def butterworth(rate: float, cutoff, mode: str = "low", order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital Butterworth filter: analogue prototype, band transform, bilinear map."""
    if mode not in ("low", "high", "band"):
        raise ValueError(f"mode must be low, high or band, not {mode}")
    edges = np.atleast_1d(np.asarray(cutoff, float))
    if len(edges) != (2 if mode == "band" else 1) or (edges <= 0).any() or (edges >= rate / 2).any():
        raise ValueError("cut-offs must lie below half the rate, two for a band")
    warped = 4 * np.tan(np.pi * edges / rate)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if mode == "low":
        zeros, poles = np.zeros(0), poles * warped[0]
        gain = np.prod(-poles).real
    elif mode == "high":
        zeros, poles, gain = np.zeros(order), warped[0] / poles, 1.0
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        p = poles * width / 2
        root = np.sqrt(p**2 - centre**2 + 0j)
        zeros, poles, gain = np.zeros(order), np.concatenate([p + root, p - root]), width**order
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    zeros = np.append((4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros)))
    return np.real(gain * np.poly(zeros)), np.real(np.poly((4 + poles) / (4 - poles)))


def notch(rate: float, f0: float, quality: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a second-order notch."""
    w = 2 * np.pi * f0 / rate
    g = 1 / (1 + np.tan(w / quality / 2))
    return g * np.array([1, -2 * np.cos(w), 1]), np.array([1, -2 * g * np.cos(w), 2 * g - 1])


def _recur(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A recursive filter sample by sample (transposed direct form)."""
    z, n = [*state.tolist(), 0.0], len(a)
    out, bs, as_ = np.empty(len(x)), b.tolist(), a.tolist()
    for i, v in enumerate(x.tolist()):
        y = bs[0] * v + z[0]
        for k in range(1, n):
            z[k - 1] = bs[k] * v + z[k] - as_[k] * y
        out[i] = y
    return out


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """A recursive filter; the answers to an impulse and to the state are found until they have died away, the rest is one convolution by FFT."""
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    state = np.zeros(n - 1) if state is None else np.asarray(state, float)
    slowest = float(np.abs(np.roots(a)).max(initial=0.0))
    # a pole's answer falls by its size with each sample; repeated poles take a little longer
    lasts = len(x) if slowest >= 1 else int(np.ceil(40 / -np.log(max(slowest, 1e-12)))) + 8 * n
    if 2 * lasts >= len(x):
        return _recur(b, a, x, state)
    impulse = _recur(b, a, np.append(1.0, np.zeros(lasts - 1)), np.zeros(n - 1))
    size = 1 << int(np.ceil(np.log2(len(x) + lasts)))
    y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(impulse, size), size)[: len(x)]
    y[:lasts] += _recur(b, a, np.zeros(lasts), state)
    return y


def steady_state(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A filter's transition matrix from one sample to the next, and its state after endless ones."""
    n = max(len(a), len(b))
    bb, aa = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    companion = np.zeros((n - 1, n - 1))
    companion[:, 0] = -aa[1:]
    companion[:-1, 1:] = np.eye(n - 2)
    return companion, np.linalg.solve(np.eye(n - 1) - companion, bb[1:] - aa[1:] * bb[0])


def final_state(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The state in which a recursive filter that started from rest ends: only samples whose trace hasn't died away matter."""
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    step, gain = steady_state(b, a)[0], b[1:] - a[1:] * b[0]
    slowest = float(np.abs(np.roots(a)).max(initial=0.0))
    x = x if slowest >= 1 else x[-(int(np.ceil(40 / -np.log(max(slowest, 1e-12)))) + 8 * n) :]
    state = np.zeros(n - 1)
    for lo in range(0, len(x), 256):  # 256 samples at once: powers of the step applied to each one's gain
        part = x[lo : lo + 256]
        powers = _powers(step.tobytes(), gain.tobytes(), len(part))
        state = powers[1] @ state + powers[0] @ part
    return state


@lru_cache(32)
def _powers(step: bytes, gain: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    gain = np.frombuffer(gain)
    step = np.frombuffer(step).reshape(len(gain), -1)
    columns, power = np.empty((len(gain), n)), np.eye(len(gain))
    for k in range(n - 1, -1, -1):
        columns[:, k] = power @ gain
        power = power @ step
    return columns, power


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, with odd padding and steady starting states: zero phase."""
    pad = min(3 * max(len(a), len(b)), len(x) - 1)
    if pad < 1:
        return x.copy()
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    steady = steady_state(b, a)[1]
    y = lfilter(b, a, long, steady * long[0])[::-1]
    return lfilter(b, a, y, steady * y[0])[::-1][pad:-pad]


def fir_taps(rate: float, low: float | None, high: float | None, stop: bool = False) -> np.ndarray:
    """An odd number of Hamming-windowed taps of a band-pass (or band-stop); transition bands of a quarter of the edge, 1 to 2 Hz wide at least where they fit."""
    widths = [w for w in (low and min(max(0.25 * low, 2.0), low), high and min(max(0.25 * high, 2.0), rate / 2 - high)) if w]
    if stop:
        widths = [max(0.5, min(1.0, *(w for w in widths)))]
    n = int(np.ceil(3.3 * rate / max(min(widths), 1e-6))) | 1
    t = np.arange(n) - n // 2
    cut = lambda f: 2 * f / rate * np.sinc(2 * f / rate * t)
    unit = (t == 0).astype(float)
    h = (cut(high) if high else unit) - (cut(low) if low else 0)
    return (unit - h if stop else h) * np.hamming(n)


def convolved(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The full convolution by FFT."""
    size = len(x) + len(h) - 1
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)


def fir_filter(x: np.ndarray, rate: float, low: float | None, high: float | None, stop: bool = False) -> np.ndarray:
    """Zero-phase band-pass (or band-stop) by ``fir_taps``, the signal continued by its odd reflection."""
    h = fir_taps(rate, low, high, stop)
    n = len(h)
    pad = min(n // 2, len(x) - 1)
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x
    return convolved(long, h)[n // 2 : n // 2 + len(long)][pad : pad + len(x)]


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal: no negative frequencies."""
    n = len(x)
    f = np.fft.fft(x)
    f[1 : (n + 1) // 2] *= 2
    f[n // 2 + 1 :] = 0
    return np.fft.ifft(f)


def moving_average(x: np.ndarray, width: int) -> np.ndarray:
    """Centred mean of ``width`` samples, edge values repeated."""
    if width <= 1:
        return x
    left = width // 2
    total = np.append(0, np.cumsum(np.pad(x, (left, width - 1 - left), mode="edge")))
    return (total[width:] - total[:-width]) / width


def bin_average(x: np.ndarray, rate: float, new_rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Bin centres and means of adjoining bins; edges round half to even, a last partial bin is dropped."""
    bins = int(np.floor(len(x) * new_rate / rate))
    if bins < 1:
        raise ValueError("the signal is shorter than one bin")
    edges = np.round(np.arange(bins + 1) * rate / new_rate).astype(int)
    edges = edges[edges <= len(x)]
    return (edges[:-1] + edges[1:]) / 2 / rate, np.add.reduceat(x[: edges[-1]], edges[:-1]) / np.diff(edges)


def decibels(power: np.ndarray) -> np.ndarray:
    """10 log10 with values of zero and below raised to the least positive value (1 if none)."""
    positive = power[power > 0]
    return 10 * np.log10(np.where(power > 0, power, positive.min() if len(positive) else 1.0))


def power_envelope(x: np.ndarray, rate: float, band=SIGMA_BAND, new_rate: float = ENVELOPE_RATE, smooth_sec: float = 1.0, db: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bin centres and power of a band: band-pass, squared envelope, moving average, bins, decibels."""
    power = np.abs(analytic(fir_filter(np.asarray(x, float), rate, *band))) ** 2
    if smooth_sec:
        power = moving_average(power, max(1, round(smooth_sec * rate)))
    t, p = bin_average(power, rate, new_rate)
    return t, decibels(p) if db else p


def welch(x: np.ndarray, rate: float, window_sec: float = WINDOW_SEC, detrend: str = "linear") -> tuple[np.ndarray, np.ndarray]:
    """One-sided density: periodic Hann windows with half overlap."""
    x = one_dimension(x)
    n = min(len(x), max(8, round(window_sec * rate)))
    step = n - n // 2
    segments = np.lib.stride_tricks.sliding_window_view(x, n)[::step].copy()
    return np.fft.rfftfreq(n, 1 / rate), densities(segments, rate, detrend).mean(0)


def densities(segments: np.ndarray, rate: float, detrend: str = "linear") -> np.ndarray:
    """One-sided density of each row: detrended, tapered by a periodic Hann window, transformed."""
    n = segments.shape[1]
    if detrend == "linear":
        t = np.arange(n) - (n - 1) / 2
        slope = segments @ t / (t @ t)
        segments = segments - (segments.mean(1, keepdims=True) + slope[:, None] * t)
    elif detrend == "constant":
        segments = segments - segments.mean(1, keepdims=True)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    p = np.abs(np.fft.rfft(segments * w)) ** 2 / (rate * (w @ w))
    p[:, 1 : -1 if n % 2 == 0 else None] *= 2
    return p


def slow_spectrum(x: np.ndarray, rate: float = ENVELOPE_RATE, band=SLOW_BAND, window_sec: float = WINDOW_SEC, detrend: str = "linear") -> dict:
    """A Welch spectrum with its peaks and band powers."""
    f, p = welch(x, rate, window_sec, detrend)
    inside = (f >= band[0]) & (f <= band[1])
    beyond = f > 0
    k, m = np.flatnonzero(inside)[p[inside].argmax()] if inside.any() else -1, np.flatnonzero(beyond)[p[beyond].argmax()]
    within, total = np.trapezoid(p[inside], f[inside]), np.trapezoid(p, f)
    at = lambda v: float(v[k]) if k >= 0 else float("nan")
    return {"freqs": f, "psd": p, "sf_env": rate, "band": band, "peak_freq": at(f), "peak_power": at(p), "full_peak_freq": float(f[m]), "full_peak_power": float(p[m]), "band_power": float(within), "total_power": float(total), "rel_band_power": float(within / total) if total > 0 else float("nan")}


def two_sided_gaussian(f, amp: float, mu: float, left: float, right: float):
    """A Gaussian with one width below mu and another from mu on."""
    return amp * np.exp(-((f - mu) ** 2) / (2 * np.where(f < mu, left, right) ** 2))


def gaussian(f, amp: float, mu: float, sd: float):
    return amp * np.exp(-((f - mu) ** 2) / (2 * sd**2))


def _side(f: np.ndarray, y: np.ndarray, mu: float, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each width of one side's half Gaussian, its products with the values and with itself."""
    g = np.exp(-(((f - mu) / widths[:, None]) ** 2) / 2)
    return g @ y, (g * g).sum(1)


def fit_two_sided(freqs: np.ndarray, corrected: np.ndarray, band=SLOW_BAND, baseline=BASELINE_BAND) -> dict:
    """Peak fitted by least squares with mu at the largest value.

    For given widths the best amplitude is a ratio of products, so only the widths are searched: on a grid of both,
    then on ever finer ones around the best. Where mu is the first or last point of the window no point tells that
    side's width, which stays at its start.
    """
    use = (freqs >= band[0]) & (freqs < baseline[0])
    f, y = freqs[use], corrected[use]
    if not len(f):
        raise ValueError("no frequencies in the fit window")
    peak = int(y.argmax())
    mu, top = float(f[peak]), float(y[peak])
    sides = [(f[f < mu], y[f < mu]), (f[f > mu], y[f > mu])]
    known = [len(x) > 0 for x, _ in sides]
    best, amp = np.array([SD_START, SD_START]), 0.0
    if top > 0:
        spans = [np.log(SD_BOUNDS) if k else np.log([SD_START, SD_START]) for k in known]
        for _ in range(9):
            grids = [np.exp(np.linspace(*s, 48)) if k else np.array([SD_START]) for s, k in zip(spans, known, strict=True)]
            (gl, hl), (gr, hr) = (_side(x, v, mu, w) for (x, v), w in zip(sides, grids, strict=True))
            along, square = top + gl[:, None] + gr[None, :], 1 + hl[:, None] + hr[None, :]
            i, j = np.unravel_index(int((np.maximum(along, 0) ** 2 / square).argmax()), along.shape)
            best, amp = np.array([grids[0][i], grids[1][j]]), max(float(along[i, j] / square[i, j]), 0.0)
            step = [(s[1] - s[0]) / 47 * 1.5 for s in spans]
            spans = [np.clip([np.log(w) - d, np.log(w) + d], *np.log(SD_BOUNDS)) for w, d in zip(best, step, strict=True)]
    left, right = (float(w) if amp > 0 and k else SD_START for w, k in zip(best, known, strict=True))
    span = np.linspace(mu - left, mu + right, 400)
    base = corrected[(freqs >= baseline[0]) & (freqs <= baseline[1])]
    threshold = 1.5 * float(base.std()) if len(base) else float("nan")
    return {"amp": float(amp), "mu": mu, "sd_left": left, "sd_right": right, "bandwidth": left + right, "auc": float(np.trapezoid(two_sided_gaussian(span, amp, mu, left, right), span)), "threshold": threshold, "detected": bool(amp > threshold)}


def fit_gaussian(freqs: np.ndarray, y: np.ndarray, mu_bounds=(0.01, 0.06)) -> dict:
    """A symmetric Gaussian with free mean, width and amplitude, searched like the two-sided one."""
    centres, spans, out = np.array(mu_bounds, float), np.log(SD_BOUNDS), (0.0, float(mu_bounds[0]), SD_START)
    for _ in range(9):
        mus, widths = np.linspace(*centres, 41), np.exp(np.linspace(*spans, 41))
        g = np.exp(-(((freqs - mus[:, None, None]) / widths[:, None]) ** 2) / 2)
        along, square = g @ y, np.maximum((g * g).sum(2), 1e-300)
        i, j = np.unravel_index(int((np.maximum(along, 0) ** 2 / square).argmax()), along.shape)
        out = (max(float(along[i, j] / square[i, j]), 0.0), float(mus[i]), float(widths[j]))
        near = [(c[1] - c[0]) / 40 * 1.5 for c in (centres, spans)]
        centres = np.clip([mus[i] - near[0], mus[i] + near[0]], *mu_bounds)
        spans = np.clip([np.log(widths[j]) - near[1], np.log(widths[j]) + near[1]], *np.log(SD_BOUNDS))
    amp, mu, sd = out
    return {"amp": amp, "mu": mu, "sd": sd, "bandwidth": 2 * sd}


def descents(freqs: np.ndarray, curves: np.ndarray, threshold: np.ndarray, beyond: np.ndarray | None = None) -> np.ndarray:
    """Of each row of ``curves``, where it sinks below its threshold from its peak (or the point ``beyond``) on.

    Between the points around it the curve is taken to be straight. A curve that never sinks ends at the last frequency.
    """
    over = curves - np.asarray(threshold, float)[:, None]
    first = curves.argmax(1) if beyond is None else np.asarray(beyond)
    sinks = (over[:, :-1] >= 0) & (over[:, 1:] < 0) & (np.arange(curves.shape[1] - 1) >= first[:, None])
    row, at, any_ = np.arange(len(curves)), sinks.argmax(1), sinks.any(1)
    drop = np.where(any_, over[row, at] - over[row, at + 1], 1.0)
    return np.where(any_, freqs[at] + np.diff(freqs)[at] * over[row, at] / drop, freqs[-1])


def peak_areas(freqs: np.ndarray, curves: np.ndarray, threshold: np.ndarray, band=SLOW_BAND) -> np.ndarray:
    """Of each row of ``curves``, the area over a line from its height at the band's start down to the threshold where it sinks below that.

    The curve's own points between both ends count. A curve that sinks at the band's start or before has none.
    """
    threshold = np.asarray(threshold, float)
    end = descents(freqs, curves, threshold)
    wide = end > band[0]
    height = np.array([np.interp(band[0], freqs, c) for c in curves])
    left = (end[:, None] - freqs) / np.where(wide, end - band[0], 1.0)[:, None]  # 1 at the band's start, 0 at the end
    above = np.maximum(curves - (left * height[:, None] + (1 - left) * threshold[:, None]), 0)
    above[~((freqs >= band[0]) & (freqs <= end[:, None]))] = np.nan
    strips = (above[:, 1:] + above[:, :-1]) / 2 * np.diff(freqs)
    return np.where(wide & np.isfinite(threshold), np.nansum(strips, 1), np.where(wide, np.nan, 0.0))


def one_dimension(x, name: str = "signal") -> np.ndarray:
    """The values as one row; several rows are an error."""
    out = np.squeeze(np.asarray(x, float))
    if out.ndim == 0:
        out = out[None]
    if out.ndim != 1:
        raise ValueError(f"{name} must have one dimension, not {out.ndim}")
    return out


def spindles(x: np.ndarray, rate: float, keep: np.ndarray | None = None, band=(12.0, 15.0), broad=(1.0, 30.0), duration=(0.5, 2.0), min_distance: float = 0.5, relative: float = 0.2, correlation: float = 0.65, rms: float = 1.5) -> list[tuple[float, float, float]]:
    """Start, end and peak second of sleep spindles by three published criteria.

    The share of the band in the broad signal's power, the correlation of both signals in moving windows, and the
    moving root mean square of the band against its mean by standard deviations; two of three mark a spindle's
    core and near ones are merged. ``keep`` masks the samples of the stages that count.
    """
    if len(x) < rate * 2:
        return []
    wide, narrow = fir_filter(x, rate, *broad), fir_filter(x, rate, *band)
    width = max(3, round(0.3 * rate))
    mean = lambda v: moving_average(v, width)
    power_b, power_w = mean(narrow**2), mean(wide**2)
    share = power_b / np.maximum(power_w, 1e-12)
    cov = mean(narrow * wide) - mean(narrow) * mean(wide)
    corr = cov / np.sqrt(np.maximum((power_b - mean(narrow) ** 2) * (power_w - mean(wide) ** 2), 1e-24))
    root = np.sqrt(power_b)
    used = root if keep is None else root[keep]
    if not len(used):
        return []
    inner = np.sort(used)[int(0.1 * len(used)) : max(int(0.9 * len(used)), 1)]
    limit = inner.mean() + rms * inner.std() if len(inner) else np.inf
    votes = mean(((share >= relative).astype(float) + (corr >= correlation) + (root >= limit)))
    core = votes > 1.999
    if keep is not None:
        core &= keep
    edge = np.diff(np.concatenate([[0], core.astype(int), [0]]))
    runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
    merged: list[list[int]] = []
    for a, b in runs:
        if merged and a - merged[-1][1] <= min_distance * rate:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    envelope = np.abs(analytic(narrow))
    out = []
    for a, b in merged:
        if duration[0] <= (b - a) / rate <= duration[1]:
            out.append((a / rate, b / rate, (a + int(envelope[a:b].argmax())) / rate))
    return out
