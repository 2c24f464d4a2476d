"""First reason wins: why records are excluded, and what is wrong with an event record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import finite, increasing, is_nan

TOLERANCE = 1e-6
# fixed values: parameters of a subject's summary that must be present, in the order in which they are reported
REQUIRED = ("peak_freq_hz", "peak_period_s", "bandwidth_hz", "auc", "chromatogram_peak_area")


def first_reason(*rules: tuple[Column, str | Column]) -> Column:
    """The text of the first rule that holds; null if none does."""
    return reduce(lambda c, r: c.when(F.coalesce(r[0], F.lit(False)), r[1]), rules[1:], F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1]))


def spectrum_problem(freqs: str = "freqs", values: str = "corr_mean") -> Column:
    """The first of six defects of a spectrum, as text; null for a sound one."""
    odd = lambda c: F.exists(c, lambda x: ~finite(x))
    return first_reason(
        (F.col(freqs).isNull() | F.col(values).isNull(), "spectrum missing"),
        ((F.size(freqs) == 0) | (F.size(values) == 0), "spectrum empty"),
        (F.size(freqs) != F.size(values), "spectrum lengths differ"),
        (odd(freqs), "frequencies not finite"),
        (odd(values), "spectrum not finite"),
        (~increasing(freqs), "frequencies not increasing"),
    )


def rate_columns(unit: str = "min") -> tuple[str, str, int]:
    """Names of a rate and its error in a unit, and the factor from minutes."""
    factors = {"min": 1, "hr": 60}
    if unit not in factors:
        raise ValueError(f"unit must be one of {sorted(factors)}")
    return f"spindle_per_{unit}", f"spindle_per_{unit}_SEM", factors[unit]


def reasons(records: DataFrame, stage: str | None, channel: str | None, unit: str = "min", tolerance: float = TOLERANCE, spectra: bool = False, by: list[str] | None = None) -> DataFrame:
    """Adds ``exclusion_reason``: what the loader found, else the first rule that a record breaks.

    With ``by`` there are many tables in one, a subject stands once in each, and no stage or channel (None) is wrong.
    """
    rate, error, _ = rate_columns(unit)
    needed = [*REQUIRED, rate, error]
    number = lambda c: F.when(~is_nan(c), F.col(c))
    rules = [
        (F.col("exclusion_reason").isNotNull(), F.col("exclusion_reason")) if "exclusion_reason" in records.columns else (F.lit(False), ""),
        (F.count("*").over(Window.partitionBy(*(by or []), "subject_id")) > 1, "duplicate subject"),
        (F.lit(stage is not None) & ~F.col("sleep_stage").eqNullSafe(stage), "wrong stage"),
        (F.lit(channel is not None) & ~F.col("channel").eqNullSafe(channel), "wrong channel"),
        (number(rate) < 0, "negative rate"),
        (number(error) < 0, "negative rate error"),
        (number("peak_freq_hz") <= 0, "peak frequency not positive"),
        (number("peak_period_s") <= 0, "peak period not positive"),
        (number("bandwidth_hz") < 0, "negative bandwidth"),
        (number("auc") < 0, "negative auc"),
        (number("chromatogram_peak_area") < 0, "negative peak area"),
        *((F.col(c).isNull() | is_nan(c), f"missing {c}") for c in needed),
        *((F.abs(c) == float("inf"), f"infinite {c}") for c in needed),
        (F.abs(F.col("peak_period_s") - 1 / F.nullif(F.col("peak_freq_hz"), F.lit(0.0))) > tolerance, "period is not 1 / frequency"),
    ]
    if spectra:
        problem = spectrum_problem()
        rules.append((problem.isNotNull(), problem))
        if "fitted_curve" in records.columns:
            rules.append((F.exists("fitted_curve", lambda x: ~finite(x)), "fitted curve not finite"))
    # a window is needed before the chain, or each rule would ask for it again
    marked = records.withColumn("_copies", rules[1][0])
    rules[1] = (F.col("_copies"), rules[1][1])
    return marked.withColumn("exclusion_reason", first_reason(*rules)).drop("_copies")


def split(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validated records, excluded ones, and the report of counts by reason."""
    bad = F.col("exclusion_reason").isNotNull()
    report = records.groupBy("exclusion_reason").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "exclusion_reason")
    return records.filter(~bad).drop("exclusion_reason"), records.filter(bad), report


def totals(records: DataFrame, stage: str, channel: str, unit: str = "min") -> DataFrame:
    """One row about records with their ``exclusion_reason``: how many there are, lack what, and stay."""
    rate, error, _ = rate_columns(unit)
    bad, own = F.col("exclusion_reason").isNotNull(), F.col("sleep_stage").eqNullSafe(stage)
    sound = spectrum_problem().isNull() if {"freqs", "corr_mean"} <= set(records.columns) else F.lit(False)
    lacks = lambda c: F.count_if(F.col(c).isNull() | is_nan(c)).alias(f"missing_{c}")
    return records.agg(
        F.count("*").alias("total"), F.count_if(own).alias("with_stage"), F.count_if(F.col("channel").eqNullSafe(channel)).alias("with_channel"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("excluded"),
        F.count_if(F.col("exclusion_reason") == "duplicate subject").alias("duplicates"), F.count_if(sound).alias("valid_spectrum"), *(lacks(c) for c in (*REQUIRED, rate, error)),
    )


def record_problems(min_bout_sec: float = 200.0) -> Column:
    """All defects of a (subject, stage, channel) event record, as an array of texts; empty for a sound one."""
    length = lambda *cs: reduce(lambda a, b: a | b, (F.size(c) != F.size(cs[0]) for c in cs[1:]))
    odd = lambda c: F.exists(c, lambda x: ~finite(x))
    spindle = F.arrays_zip("spindle_start", "spindle_peak", "spindle_stop")
    bout = F.arrays_zip("bout_start", "bout_stop", "bout_n_spindles")
    names = ("freqs", "raw_mean", "corr_mean", "spindle_start", "spindle_stop", "spindle_peak", "bout_start", "bout_stop", "bout_n_spindles")
    rules = [
        *((F.col(c).isNull(), f"missing {c}") for c in names),
        (length("freqs", "raw_mean", "corr_mean"), "spectrum lengths differ"),
        (length("spindle_start", "spindle_stop", "spindle_peak"), "spindle lengths differ"),
        (length("bout_start", "bout_stop", "bout_n_spindles"), "bout lengths differ"),
        (odd("freqs") | odd("raw_mean") | odd("corr_mean"), "spectrum not finite"),
        (F.exists(spindle, lambda s: (s["spindle_start"] > s["spindle_peak"]) | (s["spindle_peak"] > s["spindle_stop"])), "spindle out of order"),
        (F.exists(bout, lambda b: b["bout_stop"] <= b["bout_start"]), "bout out of order"),
        (F.exists(bout, lambda b: b["bout_stop"] - b["bout_start"] < min_bout_sec - TOLERANCE), "bout too short"),
        (F.exists("bout_n_spindles", lambda n: n < 1), "bout without spindle"),
        (F.aggregate("bout_n_spindles", F.lit(0).cast("long"), lambda a, n: a + n) != F.size("spindle_start"), "spindles of bouts don't add up"),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(text)) for cond, text in rules)))
