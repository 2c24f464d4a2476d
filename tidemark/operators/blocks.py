"""Filters on signals of any length: a channel is many rows, and no task ever holds a whole night.

Rows are (keys, block, sf, samples), blocks numbered from 0 in each channel and of equal length but for the last, as
``sources.edf_source`` gives them. What a block needs of its neighbours is joined to it by (keys, block), so that a
channel is spread over the cluster by its blocks:

- a filter of finite length takes the ends of the blocks beside (overlap-save);
- a recursive filter takes its state. Each block's own share of the final state is found on its own; these few numbers
  are composed from block to block by powers of the transition matrix, and then every block is filtered from
  the state it starts with. The backward pass is the same from the end.

Results equal those of the whole signal but for rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..session import ship

Design = Callable[[float], tuple[np.ndarray, np.ndarray]]


def cut(signals: DataFrame, keys: list[str], seconds: float = 600.0) -> DataFrame:
    """Signals (keys, sf, samples) as blocks; the start of each in seconds."""
    size = F.greatest(F.round(F.col("sf") * seconds).cast("int"), F.lit(1))
    many = F.greatest(F.ceil(F.size("samples") / size).cast("int"), F.lit(1))
    rows = signals.select(*keys, "sf", "samples", size.alias("_size"), F.explode(F.sequence(F.lit(0), many - 1)).alias("block"))
    return rows.select(*keys, "block", "sf", (F.col("block") * F.col("_size") / F.col("sf")).alias("start"), F.slice("samples", F.col("block") * F.col("_size") + 1, F.col("_size")).alias("samples"))


def joined(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks as whole signals again, for channels that fit a row."""
    parts = blocks.groupBy(*keys, "sf").agg(F.array_sort(F.collect_list(F.struct("block", "samples"))).alias("_parts"))
    return parts.select(*keys, "sf", F.flatten(F.transform("_parts", lambda p: p["samples"])).alias("samples"))


def _mapped(df: DataFrame, run: Callable[[dict], dict], schema: str, drop: list[str] = ()) -> DataFrame:
    """``run`` on each row as a dict; Arrow batches are small, as rows are long."""
    ship(df.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                yield pd.DataFrame([run(r)])

    return df.mapInPandas(rows, schema)


def _schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)


def _ends(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The number of each channel's last block."""
    return blocks.groupBy(*keys).agg(F.max("block").alias("_last"))


def _beside(blocks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Adds _last, and _before and _after: up to ``width`` samples of the blocks on either side."""
    on = [*keys, "block"]
    tail = blocks.select(*keys, (F.col("block") + 1).alias("block"), F.when(F.size("samples") > width, F.slice("samples", -width, width)).otherwise(F.col("samples")).alias("_before"))
    head = blocks.select(*keys, (F.col("block") - 1).alias("block"), F.slice("samples", 1, width).alias("_after"))
    return blocks.join(tail, on, "left").join(head, on, "left").join(_ends(blocks, keys), keys)


def fir(blocks: DataFrame, keys: list[str], low: float | None, high: float | None, stop: bool = False, highest_rate: float = 1024.0) -> DataFrame:
    """The zero-phase band-pass (or band-stop) of ``kernels.fir_filter``; ``highest_rate`` bounds what neighbours give."""
    width = 2 * (len(K.fir_taps(highest_rate, low, high, stop)) // 2 + 1)
    out = [*keys, "block", "sf", *(["start"] if "start" in blocks.columns else []), "samples"]

    def run(r: dict) -> dict:
        x, h = np.asarray(r["samples"], float), K.fir_taps(r["sf"], low, high, stop)
        half = len(h) // 2
        before, after = (np.zeros(0) if v is None else np.asarray(v, float) for v in (r["_before"], r["_after"]))
        if not len(before) and not len(after):
            y = K.fir_filter(x, r["sf"], low, high, stop)
        else:
            if min([len(v) for v, there in ((before, r["block"] > 0), (x, r["block"] < r["_last"])) if there], default=half) < half:
                raise ValueError(f"blocks of {len(x)} samples are shorter than the filter's {half}")
            long, begin = np.concatenate([before, x, after]), len(before)
            if r["block"] == 0:
                long, begin = np.concatenate([2 * long[0] - long[half:0:-1], long]), half
            if r["block"] == r["_last"] or (r["block"] == r["_last"] - 1 and len(after) < half):
                long = np.concatenate([long, 2 * long[-1] - long[-2 : -half - 2 : -1]])
            y = K.convolved(long, h)[half + begin : half + begin + len(x)]
        return {c: r[c] for c in out[:-1]} | {"samples": y}

    return _mapped(_beside(blocks, keys, width), run, _schema(blocks, out))


def _carried(blocks: DataFrame, keys: list[str], design: Design, backward: bool, steady: bool) -> DataFrame:
    """One pass of a recursive filter over (keys, block, sf, samples), from the last block to the first if ``backward``."""
    names = [*keys, "block", "sf"]

    def share(r: dict) -> dict:
        b, a = design(r["sf"])
        x = np.asarray(r["samples"], float)[:: -1 if backward else 1]
        return {c: r[c] for c in names} | {"size": len(x), "first": float(x[0]) if len(x) else 0.0, "gain": K.final_state(b, a, x).tolist()}

    shares = _mapped(blocks.select(*names, "samples"), share, _schema(blocks, names) + ", size long, first double, gain array<double>")
    # a few numbers for each block of a channel
    chains = shares.groupBy(*keys).agg(F.first("sf").alias("sf"), F.sort_array(F.collect_list(F.struct("block", "size", "first", "gain")), not backward).alias("chain"))

    def compose(r: dict) -> dict:
        b, a = design(r["sf"])
        step, settled = K.steady_state(b, a)
        chain = r["chain"]
        state = settled * (next((c["first"] for c in chain if c["size"]), 0.0) if steady else 0.0)
        states = []
        for c in chain:
            states.append({"block": int(c["block"]), "state": state.tolist()})
            state = np.linalg.matrix_power(step, int(c["size"])) @ state + np.asarray(c["gain"], float)
        return {k: r[k] for k in keys} | {"states": states}

    kinds = _schema(blocks, ["block"]).replace("`block`", "block:").replace(": ", ":")
    composed = _mapped(chains, compose, _schema(blocks, keys) + f", states array<struct<{kinds},state:array<double>>>")
    states = composed.select(*keys, F.explode("states").alias("_s")).select(*keys, F.col("_s.block").alias("block"), F.col("_s.state").alias("_state"))

    def run(r: dict) -> dict:
        b, a = design(r["sf"])
        x = np.asarray(r["samples"], float)[:: -1 if backward else 1]
        y = K.lfilter(b, a, x, np.asarray(r["_state"], float)) if len(x) else x
        return {c: r[c] for c in names} | {"samples": y[:: -1 if backward else 1]}

    return _mapped(blocks.select(*names, "samples").join(states, [*keys, "block"]), run, _schema(blocks, [*names, "samples"]))


def recursive(blocks: DataFrame, keys: list[str], design: Design, zero_phase: bool = True) -> DataFrame:
    """A recursive filter, by ``design`` (rate to b, a): forward and backward as ``kernels.filtfilt``, or forward only."""
    plain = blocks.select(*keys, "block", "sf", "samples")
    if not zero_phase:
        return _carried(plain, keys, design, False, False)
    longest = 64  # samples that a reflection takes at most: three times a filter's coefficients

    def extended(r: dict) -> dict:
        b, a = design(r["sf"])
        pad, x = 3 * max(len(a), len(b)), np.asarray(r["samples"], float)
        if pad >= longest:
            raise ValueError(f"filters of {max(len(a), len(b))} coefficients reflect too many samples")
        before = np.zeros(0) if r["_before"] is None else np.asarray(r["_before"], float)
        after = np.zeros(0) if r["_after"] is None else np.asarray(r["_after"], float)
        if r["block"] == r["_last"] == 0:
            pad = min(pad, len(x) - 1)
        own = x
        if pad > 0 and r["block"] == 0:
            near = np.concatenate([x, after])
            own = np.concatenate([2 * near[0] - near[pad:0:-1], own])
        if pad > 0 and r["block"] == r["_last"]:
            near = np.concatenate([before, x])
            own = np.concatenate([own, 2 * near[-1] - near[-2 : -pad - 2 : -1]])
        return {c: r[c] for c in [*keys, "block", "sf"]} | {"samples": own, "left": pad if r["block"] == 0 else 0, "size": len(x)}

    long = _mapped(_beside(plain, keys, longest), extended, _schema(plain, plain.columns) + ", left int, size int")
    there = _carried(long.select(plain.columns), keys, design, False, True)
    back = _carried(there, keys, design, True, True)
    return back.join(long.select(*keys, "block", "left", "size"), [*keys, "block"]).select(*keys, "block", "sf", F.slice("samples", F.col("left") + 1, F.col("size")).alias("samples"))
