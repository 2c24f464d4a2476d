"""Sleep statistics, event rates and whole-night features of subjects."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.scalars import STAGE_GROUPS
from ..session import ship
from . import intervals

# fixed values: names of the statistics, in their order
STATISTICS = ["TIB", "SPT", "WASO", "TST", "N1", "N2", "N3", "REM", "NREM", "SOL", "Lat_N1", "Lat_N2", "Lat_N3", "Lat_REM", "%N1", "%N2", "%N3", "%REM", "%NREM", "SE", "SME"]
#: What one (subject, channel, stage) record holds.
RECORD = "subject_id string, stage string, channel string, freqs array<double>, raw_mean array<double>, corr_mean array<double>, spindle_start array<double>, spindle_stop array<double>, spindle_peak array<double>, bout_start array<double>, bout_stop array<double>, bout_n_spindles array<long>, " + ", ".join(f"band_freqs_{b} array<double>, band_psd_{b} array<double>" for b in K.BANDS) + ", error_type string, error_message string"


def statistics(epochs: DataFrame, key: str = "subject_id", epoch_sec: float = 30.0) -> DataFrame:
    """The 21 statistics of each subject's epochs (epoch_idx, code), in minutes and percent; absent stages give null latencies."""
    e = epoch_sec / 60
    code, at = F.col("code"), F.col("epoch_idx")
    asleep = code.isin(1, 2, 3, 4)
    edges = epochs.groupBy(key).agg(F.min(F.when(asleep, at)).alias("_f"), F.max(F.when(asleep, at)).alias("_l"))
    names = {1: "N1", 2: "N2", 3: "N3", 4: "REM"}
    out = epochs.join(edges, key).groupBy(key).agg(
        (e * F.count("*")).alias("TIB"),
        (e * (F.max("_l") - F.max("_f") + 1)).alias("SPT"),
        (e * F.count_if((code == 0) & at.between(F.col("_f"), F.col("_l")))).alias("WASO"),
        (e * F.count_if(asleep)).alias("TST"),
        *((e * F.count_if(code == c)).alias(n) for c, n in names.items()),
        (e * F.count_if(code.isin(1, 2, 3))).alias("NREM"),
        (e * F.max("_f")).alias("SOL"),
        *((e * F.min(F.when(code == c, at))).alias(f"Lat_{n}") for c, n in names.items()),
    )
    share = lambda c, of: 100 * F.col(c) / F.nullif(F.col(of), F.lit(0.0))
    for n in ("N1", "N2", "N3", "REM", "NREM"):
        out = out.withColumn(f"%{n}", share(n, "TST"))
    return out.withColumn("SE", share("TST", "TIB")).withColumn("SME", share("TST", "SPT")).select(key, *(F.col(f"`{c}`") for c in STATISTICS))


def event_rate(bouts: DataFrame, keys: list[str], unit: str = "min") -> DataFrame:
    """Events per minute (or hour) of bout, and the standard error of the bouts' own rates."""
    factor = {"min": 1, "hr": 60}[unit]
    length = (F.col("stop") - F.col("start")) / 60
    own = F.col("n_spindles") / length
    n = F.count("*")
    rate = F.when(F.sum(length) > 0, F.sum("n_spindles") / F.sum(length) * factor)
    return bouts.groupBy(*keys).agg(rate.alias("rate"), (F.when(n > 1, F.stddev_samp(own) / F.sqrt(n)).otherwise(0.0) * factor).alias("rate_sem"), n.alias("bouts"))


#: Bytes of all nights' stages up to which they are sent to where signals are; beyond, both sides are shuffled.
BROADCAST_NIGHTS = 64 << 20


def with_codes(df: DataFrame, epochs: DataFrame) -> DataFrame:
    """Adds each subject's stage codes, one byte an epoch; subjects without epochs go.

    What is added is small and what it is added to is large, so it is sent there if its counted size allows.
    """
    codes = epochs.groupBy("subject_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch_idx", "code"))), lambda x: x["code"].cast("tinyint")).alias("codes"))
    size = epochs.agg(F.count("*").alias("n"), F.approx_count_distinct("subject_id").alias("s")).first()
    return df.join(F.broadcast(codes) if size.n + 64 * size.s <= BROADCAST_NIGHTS else codes, "subject_id")


def stage_records(signals: DataFrame, epochs: DataFrame | None, epoch_sec: float = K.EPOCH_SEC, min_sec: float = K.MIN_BOUT_SEC, need_spindle: bool = True, stages: tuple[str, ...] = tuple(STAGE_GROUPS)) -> DataFrame:
    """Records of every (subject, channel, stage group) from signals (subject_id, channel, sf, samples) and epochs.

    Without epochs signals have their nights as ``codes``. Each channel's spindles and envelope are found once and
    used for all stages. Failures become records with an error, and rows that come with an error stay as they are.
    """
    ship(signals.sparkSession)
    joined = signals if epochs is None else with_codes(signals, epochs)
    columns = [c.split(" ")[0] for c in RECORD.split(", ")]
    failed = [c if c in signals.columns else F.lit(None).cast("string").alias(c) for c in ("error_type", "error_message")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b.itertuples(index=False):
                if s.error_type is not None:
                    rows = [dict.fromkeys(columns) | {"subject_id": s.subject_id, "channel": s.channel, "error_type": s.error_type, "error_message": s.error_message}]
                else:
                    rows = channel_records(s.subject_id, s.channel, float(s.sf), np.asarray(s.samples, float), np.asarray(s.codes), epoch_sec, min_sec, need_spindle, stages)
                yield pd.DataFrame(rows, columns=columns)

    return joined.select("subject_id", "channel", "sf", "samples", "codes", *failed).mapInPandas(run, RECORD)


def channel_records(subject: str, channel: str, rate: float, x: np.ndarray, codes: np.ndarray, epoch_sec: float, min_sec: float, need_spindle: bool, stages: tuple[str, ...] = tuple(STAGE_GROUPS)) -> list[dict]:
    """The records of one channel, one for each stage group."""
    empty = {c.split(" ")[0]: np.zeros(0, np.int64 if "n_spindles" in c else float) for c in RECORD.split(", ") if "array" in c}
    base = {"subject_id": subject, "channel": channel, "error_type": None, "error_message": None}
    try:
        keep = np.repeat(np.isin(codes, (1, 2, 3)), round(epoch_sec * rate))[: len(x)]
        keep = np.pad(keep, (0, len(x) - len(keep)))
        events = np.array(K.spindles(x, rate, keep)).reshape(-1, 3)
        t, power = K.power_envelope(x, rate)
    except Exception as problem:  # a channel's failure is a record; the others go on
        return [base | empty | {"stage": stage, "error_type": type(problem).__name__, "error_message": str(problem)} for stage in stages]
    out = []
    for stage, members in STAGE_GROUPS.items():
        if stage not in stages:
            continue
        inside = np.isin(codes, members)
        edge = np.diff(np.concatenate([[0], inside.astype(int), [0]]))
        runs = [(a * epoch_sec, b * epoch_sec) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if (b - a) * epoch_sec >= min_sec]
        counts = [int(((events[:, 2] >= a) & (events[:, 2] < b)).sum()) for a, b in runs]
        kept = [(r, n) for r, n in zip(runs, counts, strict=True) if n or not need_spindle]
        raw, corrected, bands, freqs = [], [], {b: [] for b in K.BANDS}, None
        for (a, b), _ in kept:
            part = power[(t >= a) & (t < b)]
            if len(part) >= K.WINDOW_SEC * K.ENVELOPE_RATE:
                f, p = K.welch(part, K.ENVELOPE_RATE)
                band = (f >= K.SLOW_BAND[0] - 1e-9) & (f <= K.SLOW_BAND[1] + 1e-9)
                area = np.trapezoid(p[band], f[band])
                if np.isfinite(area) and area > 0:
                    freqs = f
                    raw.append(p / area)
                    corrected.append(raw[-1] - raw[-1][(f >= K.BASELINE_BAND[0] - 1e-9) & (f <= K.BASELINE_BAND[1] + 1e-9)].mean())
            piece = x[round(a * rate) : round(b * rate)]
            if len(piece) >= K.BAND_WINDOW_SEC * rate and np.isfinite(piece).all():
                g, d = K.welch(piece, rate, K.BAND_WINDOW_SEC)
                for name, (lo, hi) in K.BANDS.items():
                    bands[name].append((g[(g >= lo) & (g <= hi)], d[(g >= lo) & (g <= hi)]))
        mine = [e for e in events if any(a <= e[2] < b for (a, b), _ in kept)]
        record = base | empty | {"stage": stage}
        if mine:
            record |= dict(zip(("spindle_start", "spindle_stop", "spindle_peak"), np.array(mine).T, strict=True))
        if kept:
            record |= {"bout_start": np.array([r[0] for r, _ in kept]), "bout_stop": np.array([r[1] for r, _ in kept]), "bout_n_spindles": np.array([n for _, n in kept], np.int64)}
        if raw:
            record |= {"freqs": freqs, "raw_mean": np.mean(raw, 0), "corr_mean": np.mean(corrected, 0)}
        for name, parts in bands.items():
            if parts:
                record |= {f"band_freqs_{name}": parts[0][0], f"band_psd_{name}": np.mean([d for _, d in parts], 0)}
        out.append(record)
    return out


def metadata_rows(subjects: DataFrame, epochs: DataFrame) -> DataFrame:
    """Subjects with their sleep statistics: 25 columns; subjects without epochs have null statistics."""
    return subjects.select("ID", "Age", "Gender", "BMI").join(statistics(epochs).withColumnRenamed("subject_id", "ID"), "ID", "left")


def stage_bouts(epochs: DataFrame, epoch_sec: float = K.EPOCH_SEC, min_sec: float = K.MIN_BOUT_SEC) -> DataFrame:
    """Bouts of all stage groups: subject_id, stage, bout_idx, start, stop."""
    parts = [intervals.bouts(epochs, F.col("code").isin(*codes), ["subject_id"], "epoch_idx", epoch_sec, min_sec).withColumn("stage", F.lit(name)) for name, codes in STAGE_GROUPS.items()]
    return reduce(DataFrame.unionByName, parts)


def stage_signal(signals: DataFrame, epochs: DataFrame, codes: tuple[int, ...], epoch_sec: float = K.EPOCH_SEC) -> DataFrame:
    """Each channel's samples of the epochs with these codes, joined in order; none gives an empty array."""
    chosen = epochs.filter(F.col("code").isin(*codes)).groupBy("subject_id").agg(F.array_sort(F.collect_list("epoch_idx")).alias("_epochs"))
    size = F.round(epoch_sec * F.col("sf")).cast("int")
    joined = signals.join(chosen, "subject_id", "left").withColumn("_n", size)
    parts = F.transform(F.coalesce("_epochs", F.array().cast("array<int>")), lambda e: F.slice("samples", e * F.col("_n") + 1, F.col("_n")))
    return joined.withColumn("samples", F.flatten(parts)).drop("_epochs", "_n")
