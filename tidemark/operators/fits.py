"""Peak fits and signal kernels over tables of arrays; one row is one curve or signal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..session import ship

FIT = "amp double, mu double, sd_left double, sd_right double, bandwidth double, auc double, threshold double, detected boolean, chromatogram_peak_area double, peak_freq_hz double, peak_period_s double, fitted_freqs array<double>, fitted_curve array<double>, fit_error string"


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)


def fit_curves(curves: DataFrame, keys: list[str], freqs: str = "freqs", values: str = "corr_mean", symmetric: bool = False) -> DataFrame:
    """The fitted peak of each row's curve; a curve that can't be fitted has its error as text.

    Rows are independent, so the fits run where the rows are, without a shuffle.
    """
    ship(curves.sparkSession)

    def one(f: np.ndarray, y: np.ndarray) -> dict:
        grid = np.linspace(*K.SLOW_BAND, 200)
        if symmetric:
            use = (f >= K.SLOW_BAND[0]) & (f <= K.SLOW_BAND[1])
            r = K.fit_gaussian(f[use], y[use])
            curve = K.gaussian(grid, r["amp"], r["mu"], r["sd"])
            r |= {"sd_left": r["sd"], "sd_right": r["sd"], "auc": float("nan"), "threshold": 1.5 * float(y[(f >= 0.06) & (f <= 0.1)].std())}
            r["detected"] = r["amp"] > r["threshold"]
        else:
            r = K.fit_two_sided(f, y)
            curve = K.two_sided_gaussian(grid, r["amp"], r["mu"], r["sd_left"], r["sd_right"])
        return r | {"chromatogram_peak_area": float(K.peak_areas(grid, curve[None], [r["threshold"]])[0]), "peak_freq_hz": r["mu"], "peak_period_s": 1 / r["mu"], "fitted_freqs": grid, "fitted_curve": curve, "fit_error": None}

    names = [c.split(" ")[0] for c in FIT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, y in zip(b[freqs], b[values], strict=True):
                try:
                    r = one(np.asarray(f, float), np.asarray(y, float))
                except (ValueError, TypeError, IndexError, ZeroDivisionError) as problem:
                    r = dict.fromkeys(names) | {"fit_error": str(problem)}
                rows.append({n: r[n] for n in names})
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return curves.select(*keys, freqs, values).mapInPandas(run, f"{_fields(curves, keys)}, {FIT}")


def map_signals(signals: DataFrame, keys: list[str], kernel, out: str = "samples", rate: str = "sf") -> DataFrame:
    """Applies ``kernel(samples, rate)`` to each row's samples: keys, rate and the new samples."""
    ship(signals.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = [np.asarray(kernel(np.asarray(x, float), float(r)), float) for x, r in zip(b["samples"], b[rate], strict=True)]
            yield b[[*keys, rate, out]]

    return signals.select(*keys, rate, "samples").mapInPandas(run, f"{_fields(signals, [*keys, rate])}, {out} array<double>")


def pipeline(*steps):
    """A kernel that applies others in turn."""
    def run(x: np.ndarray, rate: float) -> np.ndarray:
        for s in steps:
            x = s(x, rate)
        return x

    return run


def butter(cutoff, mode: str = "low", order: int = 2, two_way: bool = True):
    """Butterworth filter as a kernel."""
    return lambda x, rate: (K.filtfilt if two_way else K.lfilter)(*K.butterworth(rate, cutoff, mode, order), x)


def notch(f0: float, quality: float = 30.0):
    """Notch filter as a kernel."""
    return lambda x, rate: K.filtfilt(*K.notch(rate, f0, quality), x)


def line_noise(f0: float = 60.0, half_width: float = 0.5):
    """Zero-phase band-stop around the mains frequency as a kernel."""
    return lambda x, rate: K.fir_filter(x, rate, f0 - half_width, f0 + half_width, stop=True)


def resampled(signals: DataFrame, keys: list[str], new_rate: float, subject: str = "subject_id") -> DataFrame:
    """All channels at one rate; those of a subject cut to the shortest."""
    at = map_signals(signals, keys, lambda x, r: K.resample(x, r, new_rate)).withColumn("sf", F.lit(float(new_rate)))
    shortest = at.groupBy(subject).agg(F.min(F.size("samples")).alias("_n"))
    return at.join(shortest, subject).withColumn("samples", F.slice("samples", F.lit(1), F.col("_n"))).drop("_n")
