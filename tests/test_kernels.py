"""Kernels and tail probabilities against closed forms and published values."""

import math

import numpy as np
import pytest

from tidemark.functions import kernels as K
from tidemark.functions import tails


def test_tails_match_tables():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert tails.t_two_sided(12.706205, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(3.0, 3) == pytest.approx(0.39162518, abs=1e-7)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_exact_rank_tests_match_enumeration():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=4), rng.normal(0.5, size=5)
    u, p = tails.mann_whitney(x, y)
    from itertools import combinations

    both = np.concatenate([x, y])
    us = [tails.midranks(both)[list(c)].sum() - 10 for c in combinations(range(9), 4)]
    top = max(u, 20 - u)
    assert p == pytest.approx(min(1, 2 * sum(v >= top for v in us) / len(us)))
    assert tails.wilcoxon(np.array([1.0, 2, 3, -4, 5]))[:2] == (4.0, 0.4375)
    assert tails.wilcoxon(np.zeros(3)) == (0.0, 1.0, 0.0)
    assert tails.kruskal([np.array([1.0, 2]), np.array([3.0, 4]), np.array([5.0, 6])])[0] == pytest.approx(4.571429, abs=1e-6)


def test_filters_have_the_gain_that_they_are_designed_for():
    gain = lambda b, a, f: abs(np.polyval(b[::-1], np.exp(-2j * np.pi * f / 128)) / np.polyval(a[::-1], np.exp(-2j * np.pi * f / 128)))
    for mode, cut, passed, stopped in (("low", 10, 1, 50), ("high", 10, 50, 1), ("band", (10, 16), 12.7, 40)):
        b, a = K.butterworth(128, cut, mode)
        assert gain(b, a, np.atleast_1d(cut)[0]) == pytest.approx(math.sqrt(0.5), abs=1e-6)
        assert gain(b, a, passed) > 0.99 and gain(b, a, stopped) < 0.05
    b, a = K.notch(128, 50)
    assert gain(b, a, 50) < 1e-6 and gain(b, a, 40) > 0.98
    with pytest.raises(ValueError):
        K.butterworth(128, 10, "pass")
    t = np.arange(1280) / 128
    x = np.sin(2 * np.pi * 13 * t)
    inner = slice(300, 900)
    assert np.allclose(K.filtfilt(*K.butterworth(128, (8, 20), "band"), x)[inner], x[inner], atol=0.02)
    assert np.abs(K.fir_filter(x, 128, 12.5, 13.5, stop=True)[inner]).max() < 0.05


def test_resampling_keeps_a_tone_and_rounds_half_to_even():
    t = np.arange(256) / 256
    x = np.sin(2 * np.pi * 8 * t)
    assert np.allclose(K.resample(x, 256, 128), np.sin(2 * np.pi * 8 * np.arange(128) / 128), atol=1e-9)
    assert len(K.resample(np.zeros(5), 2, 1)) == 2
    assert K.resample_channels([], [], 128).shape == (0, 0)
    assert K.resample_channels([np.zeros(100), np.zeros(90)], [128, 128], 128).shape == (2, 90)


def test_envelope_and_spectrum_find_the_modulation():
    t = np.arange(128 * 400) / 128
    x = np.sin(2 * np.pi * 13 * t) * (1 + 0.5 * np.sin(2 * np.pi * 0.02 * t))
    at, power = K.power_envelope(x, 128.0)
    assert len(at) == 400 and at[0] == 0.5
    assert K.slow_spectrum(power)["peak_freq"] == pytest.approx(0.02)
    with pytest.raises(ValueError):
        K.bin_average(np.zeros(50), 128, 1)
    assert K.bin_average(np.arange(10.0), 3, 1)[1].tolist() == [1, 4, 7]
    assert K.moving_average(np.array([0.0, 0, 3, 0, 0]), 3).tolist() == [0, 1, 1, 1, 0]


def test_fit_recovers_a_peak_and_keeps_edge_widths():
    f = np.arange(51) * 0.01
    r = K.fit_two_sided(f, K.two_sided_gaussian(f, 12, 0.02, 0.006, 0.015))
    assert (r["amp"], r["sd_left"], r["sd_right"]) == pytest.approx((12, 0.006, 0.015), rel=1e-6) and r["detected"]
    assert K.fit_two_sided(f, K.two_sided_gaussian(f, 3, 0.01, 0.01, 0.02))["sd_left"] == 0.01
    assert not K.fit_two_sided(f, -np.ones(51))["detected"]
    with pytest.raises(ValueError):
        K.fit_two_sided(np.array([0.2]), np.array([1.0]))
    g = K.fit_gaussian(f[:10], K.gaussian(f[:10], 5, 0.03, 0.01))
    assert (g["amp"], g["mu"]) == pytest.approx((5, 0.03), rel=0.05)


def test_area_and_crossing():
    f, y = np.linspace(0.01, 0.1, 200), np.linspace(1, 0, 200)
    assert K.descents(f, np.stack([y, np.ones(200), y]), [0.5, 0.5, 0.25]) == pytest.approx([0.055, 0.1, 0.0775])
    assert K.peak_areas(f, y[None], [0.5]) == pytest.approx([0], abs=1e-12)
    # by hand: points at 1 to 5, the line from (1, 0) to where the curve sinks through 1 at 4.5, points up to 4
    f, y = np.arange(1.0, 7.0), np.array([0.0, 4.0, 3.0, 2.0, 0.0, 0.0])
    assert K.descents(f, y[None], [1.0])[0] == 4.5
    above = [v - (x - 1) / 3.5 for x, v in zip((1, 2, 3, 4), (0, 4, 3, 2))]
    want = sum((a + b) / 2 for a, b in zip(above, above[1:]))
    assert K.peak_areas(f, np.stack([y, y * 0 - 1]), [1.0, 1.0], band=(1.0, 6.0))[0] == pytest.approx(want)
    assert K.peak_areas(f, y[None], [1.0], band=(4.5, 6.0))[0] == 0 and np.isnan(K.peak_areas(f, y[None], [np.nan], band=(1.0, 6.0))[0])


def test_fits_are_the_best_of_an_enumeration():
    """No point of a dense grid of widths and amplitudes, or of means and widths, has a smaller square."""
    r = np.random.default_rng(7)
    f = np.arange(51) * 0.01
    for _ in range(20):
        y = K.two_sided_gaussian(f, r.uniform(2, 20), r.choice([0.02, 0.03, 0.04]), r.uniform(0.003, 0.02), r.uniform(0.003, 0.03)) + r.normal(0, 0.7, 51)
        use = (f >= 0.01) & (f < 0.06)
        got = K.fit_two_sided(f, y)
        loss = lambda amp, left, right: ((K.two_sided_gaussian(f[use], amp, got["mu"], left, right) - y[use]) ** 2).sum()  # noqa: E731, B023
        own = loss(got["amp"], got["sd_left"], got["sd_right"])
        widths = np.geomspace(1e-3, 0.05, 60)
        grid = [np.linspace(0, 1.5 * y[use].max(), 40)[:, None, None], widths[:, None], widths]
        shape = np.where(f[use] < got["mu"], grid[1][..., None], grid[2][:, None])
        model = grid[0][..., None] * np.exp(-((f[use] - got["mu"]) ** 2) / (2 * shape**2))
        assert own <= ((model - y[use]) ** 2).sum(-1).min() + 1e-9
        g = K.fit_gaussian(f[1:11], y[1:11])
        mine = ((K.gaussian(f[1:11], g["amp"], g["mu"], g["sd"]) - y[1:11]) ** 2).sum()
        mu, sd = np.linspace(0.01, 0.06, 60)[:, None, None], widths[:, None]
        shape = np.exp(-((f[1:11] - mu) ** 2) / (2 * sd**2))
        amp = np.maximum((shape * y[1:11]).sum(-1) / (shape**2).sum(-1), 0)
        assert mine <= ((amp[..., None] * shape - y[1:11]) ** 2).sum(-1).min() + 1e-9


def test_a_fit_takes_little_time():
    import time

    f = np.arange(51) * 0.01
    y = K.two_sided_gaussian(f, 12, 0.03, 0.006, 0.015)
    K.fit_two_sided(f, y)
    began = time.thread_time()
    for _ in range(10):
        K.fit_two_sided(f, y)
    assert (time.thread_time() - began) / 10 < 0.026


def test_filters_by_convolution_equal_the_recursion():
    r = np.random.default_rng(4)
    for b, a in (K.butterworth(128, (8, 20), "band"), K.notch(128, 50), K.butterworth(128, 1, "high", 4), K.butterworth(128, 0.05, "low")):
        x = r.normal(0, 5, 30_000) + 100
        n = max(len(a), len(b))
        state = r.normal(size=n - 1)
        direct = K._recur(np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a))), x, state)
        assert np.allclose(K.lfilter(b, a, x, state), direct, atol=1e-8 * np.abs(direct).max())


def test_one_dimension():
    assert K.one_dimension([[1.0, 2.0]]).tolist() == [1, 2] and K.one_dimension(3.0).tolist() == [3]
    with pytest.raises(ValueError, match="one dimension"):
        K.one_dimension(np.zeros((2, 2)))


def test_spindles_are_found_where_they_are():
    x = np.random.default_rng(0).normal(0, 5, 128 * 60)
    x[128 * 20 : 128 * 21] += 40 * np.sin(2 * np.pi * 13 * np.arange(128) / 128) * np.hanning(128)
    found = K.spindles(x, 128.0)
    assert len(found) == 1 and 20 < found[0][2] < 21
    assert K.spindles(np.zeros(10), 128.0) == []
