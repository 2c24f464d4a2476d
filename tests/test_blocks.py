"""Filters by blocks against the whole signal."""

import numpy as np
import pytest

from tidemark.functions import kernels as K
from tidemark.operators import blocks

KEYS = ["subject_id", "channel"]


@pytest.fixture(scope="module")
def signals():
    r = np.random.default_rng(2)
    return {("a", "C3"): (128.0, r.normal(0, 5, 128 * 1850).cumsum() / 50), ("a", "C4"): (64.0, r.normal(3, 5, 64 * 1205)), ("b", "C3"): (128.0, r.normal(0, 1, 128 * 40)), ("c", "C3"): (100.0, r.normal(0, 1, 100 * 600 * 2 + 7)), ("c", "C4"): (100.0, r.normal(0, 1, 5))}


@pytest.fixture(scope="module")
def frame(spark, signals):
    return blocks.cut(spark.createDataFrame([(*k, sf, x.tolist()) for k, (sf, x) in signals.items()], "subject_id string, channel string, sf double, samples array<double>"), KEYS).cache()


def whole(df):
    return {(r.subject_id, r.channel): np.array(r.samples) for r in blocks.joined(df, KEYS).collect()}


def test_cut_and_joined(frame, signals):
    got = whole(frame)
    assert all(np.array_equal(got[k], x) for k, (_, x) in signals.items())
    assert sorted((r.block, r.start, len(r.samples)) for r in frame.filter("subject_id = 'c' AND channel = 'C3'").collect()) == [(0, 0.0, 60_000), (1, 600.0, 60_000), (2, 1200.0, 7)]


@pytest.mark.parametrize("band", [(10.0, 16.0, False), (0.5, None, False), (59.0 / 2, 61.0 / 2, True)])
def test_finite_filters(frame, signals, band):
    got = whole(blocks.fir(frame, KEYS, *band, highest_rate=128.0))
    for k, (sf, x) in signals.items():
        assert np.abs(got[k] - K.fir_filter(x, sf, *band)).max() < 1e-9 * max(1, np.abs(x).max())


@pytest.mark.parametrize("design", [lambda sf: K.butterworth(sf, 4.0), lambda sf: K.butterworth(sf, 0.5, "high"), lambda sf: K.butterworth(sf, (10.0, 16.0), "band"), lambda sf: K.notch(sf, 25.0)])
def test_recursive_filters(frame, signals, design):
    both, forward = whole(blocks.recursive(frame, KEYS, design)), whole(blocks.recursive(frame, KEYS, design, zero_phase=False))
    for k, (sf, x) in signals.items():
        b, a = design(sf)
        assert np.abs(both[k] - K.filtfilt(b, a, x)).max() < 1e-9 * max(1, np.abs(x).max())
        assert np.abs(forward[k] - K.lfilter(b, a, x)).max() < 1e-9 * max(1, np.abs(x).max())


def test_blocks_shorter_than_a_filter_are_told(spark):
    df = blocks.cut(spark.createDataFrame([("a", 128.0, [0.0] * 128 * 30)], "subject_id string, sf double, samples array<double>"), ["subject_id"], 1.0)
    with pytest.raises(Exception, match="shorter than the filter"):
        blocks.fir(df, ["subject_id"], 0.5, 4.0, highest_rate=128.0).collect()


def test_final_states():
    x = np.random.default_rng(0).normal(0, 1, 3000)
    b, a = K.butterworth(128.0, (0.5, 4.0), "band")
    y = K.lfilter(b, a, np.append(x, np.zeros(50)))[3000:]
    assert np.allclose(K.lfilter(b, a, np.zeros(50), K.final_state(b, a, x)), y, atol=1e-10)
