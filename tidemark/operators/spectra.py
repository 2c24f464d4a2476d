"""Spectra as DataFrame plans: bins, Welch, normalisation, baselines, bands and curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kernels import densities
from ..functions.scalars import in_band
from ..session import ship


def bin_means(series: DataFrame, keys: list[str], t: str, value: str, width: float) -> DataFrame:
    """Means over bins of ``width`` in t: keys, bin, mean, n."""
    return series.groupBy(*keys, F.floor(F.col(t) / width).alias("bin")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def welch(series: DataFrame, keys: list[str], index: str, value: str, rate: float = 1.0, size: int = 100) -> DataFrame:
    """One-sided Welch density of evenly sampled series: keys, k, freq, psd, segments.

    Half-overlapping segments lose their line of regression and are tapered by a periodic Hann window. Each
    sample goes to its one or two segments; a segment, whose size is fixed, is one array, and arrays are transformed
    side by side in Arrow batches. Densities are averaged before their shuffle.
    """
    ship(series.sparkSession)
    step = size // 2
    last = F.floor(F.col(index) / step)
    parts = series.select(*keys, F.col(index).alias("_i"), F.col(value).cast("double").alias("_x"), F.explode(F.array(last - 1, last)).alias("segment")).filter("segment >= 0")
    at = F.struct((F.col("_i") - F.col("segment") * step).alias("j"), F.col("_x").alias("x"))
    whole = parts.groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(at)).alias("_s")).filter(F.size("_s") == size)
    arrays = whole.select(*keys, F.transform("_s", lambda p: p["x"]).alias("_s"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrays.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                p = densities(part.column("_s").flatten().to_numpy(zero_copy_only=False).reshape(-1, size), rate)
                ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], [*keys, "_p"])

    each = arrays.mapInArrow(run, f"{schema}{', ' if keys else ''}_p array<double>").select(*keys, F.posexplode("_p").alias("k", "_d"))
    return each.groupBy(*keys, "k").agg(F.avg("_d").alias("psd"), F.count("*").alias("segments")).withColumn("freq", F.col("k") * rate / size).select(*keys, "k", "freq", "psd", "segments")


def trapezoid(spectra: DataFrame, keys: list[str], lo: float, hi: float, value: str = "psd", out: str = "area") -> DataFrame:
    """Area under each spectrum between lo and hi, both bins included."""
    order = Window.partitionBy(*keys).orderBy("freq")
    inside = spectra.filter(in_band("freq", lo - 1e-9, hi + 1e-9))
    inside = inside.withColumn("_f", F.lead("freq").over(order)).withColumn("_v", F.lead(value).over(order))
    return inside.groupBy(*keys).agg(F.coalesce(F.sum((F.col(value) + F.col("_v")) / 2 * (F.col("_f") - F.col("freq"))), F.lit(0.0)).alias(out))


def relative_and_corrected(spectra: DataFrame, keys: list[str], band=(0.01, 0.1), baseline=(0.06, 0.1)) -> DataFrame:
    """Adds raw (density over the band's area) and corrected (raw less its mean over the baseline); spectra without area go."""
    area = trapezoid(spectra, keys, *band).filter((F.col("area") > 0) & (F.col("area") < float("inf")))
    whole = Window.partitionBy(*keys)
    raw = spectra.join(area, keys).withColumn("raw", F.col("psd") / F.col("area")).drop("area")
    base = F.avg(F.when(in_band("freq", baseline[0] - 1e-9, baseline[1] + 1e-9), F.col("raw"))).over(whole)
    return raw.withColumn("corrected", F.col("raw") - base)


def peaks(spectra: DataFrame, keys: list[str], band=(0.01, 0.1), value: str = "psd") -> DataFrame:
    """Largest value in the band and beyond zero; the first of equal ones."""
    best = lambda cond: F.max_by("freq", F.when(cond, F.struct(F.col(value), -F.col("k"))))
    inside, beyond = in_band("freq", band[0] - 1e-9, band[1] + 1e-9), F.col("k") > 0
    return spectra.groupBy(*keys).agg(best(inside).alias("peak_freq"), F.max(F.when(inside, F.col(value))).alias("peak_power"), best(beyond).alias("full_peak_freq"), F.max(F.when(beyond, F.col(value))).alias("full_peak_power"))


def mean_curves(curves: DataFrame, group: list[str], value: str, at: list[str] | None = None) -> DataFrame:
    """Mean, standard error (0 for one curve) and number of curves at each frequency of each group."""
    n = F.count(value)
    sem = F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).when(n == 1, 0.0)
    return curves.groupBy(*group, *(at or ["k"])).agg(F.avg(value).alias("mean"), sem.alias("sem"), n.alias("n"))


def same_grid(curves: DataFrame, group: list[str], curve: str, freqs: str = "freqs", tolerance: float = 1e-9) -> DataFrame:
    """Curves on the grid of their group's first curve (by its key); others go."""
    first = curves.groupBy(*group).agg(F.min_by(freqs, curve).alias("_grid"))
    near = F.forall(F.zip_with(freqs, "_grid", lambda a, b: F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))), lambda ok: ok)
    return curves.join(first, group).filter((F.size(freqs) == F.size("_grid")) & near).drop("_grid")


def decibels(series: DataFrame, keys: list[str], power: str, out: str = "db") -> DataFrame:
    """10 log10, values of zero and below raised to the series' least positive value (1 if none)."""
    least = F.min(F.when(F.col(power) > 0, F.col(power))).over(Window.partitionBy(*keys))
    return series.withColumn(out, 10 * F.log10(F.when(F.col(power) > 0, F.col(power)).otherwise(F.coalesce(least, F.lit(1.0)))))


def crossing(curves: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """Where each curve first falls through the threshold at or after its peak; its last frequency if it never does."""
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("freq")
    peak = F.max_by("freq", F.struct(F.col(value), -F.col("freq"))).over(whole)
    c = curves.withColumn("_p", peak).withColumn("_f", F.lead("freq").over(order)).withColumn("_v", F.lead(value).over(order))
    down = (F.col("freq") >= F.col("_p")) & (F.col(value) >= threshold) & (F.col("_v") < threshold)
    at = F.col("freq") + (F.col(value) - threshold) / (F.col(value) - F.col("_v")) * (F.col("_f") - F.col("freq"))
    return c.groupBy(*keys).agg(F.coalesce(F.min(F.when(down, at)), F.max("freq")).alias("crossing"))


def crop(curves: DataFrame, lo: float, hi: float, freqs: str = "freqs", values: str = "corr_mean") -> DataFrame:
    """Arrays of frequencies and values cut to a band, both ends included."""
    zipped = F.filter(F.arrays_zip(F.col(freqs).alias("f"), F.col(values).alias("v")), lambda x: x["f"].between(lo - 1e-9, hi + 1e-9))
    both = curves.withColumn("_z", zipped)
    return both.withColumn(freqs, F.transform("_z", lambda x: x["f"])).withColumn(values, F.transform("_z", lambda x: x["v"])).drop("_z")
