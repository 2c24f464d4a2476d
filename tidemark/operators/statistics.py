"""Group statistics: aggregates and ranks as plans, p-values of their few results on the driver side of a UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tails
from ..functions.scalars import finite
from ..session import shared_folder, ship

#: Estimated bytes of input up to which one task may hold or order a group's values; beyond, they are spread.
ONE_TASK_BYTES = 32 << 20
#: Groups up to which a row for each is sent to all tasks.
FEW_GROUPS = 100_000
# fixed values: limits of the choice between tests
SKEW_LIMIT, OUTLIER_IQR, MIN_SIZE = 1.0, 3.0, 8


def _large(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > ONE_TASK_BYTES


def with_group(df: DataFrame, per_group: DataFrame, group: list[str]) -> DataFrame:
    """Rows with the one row of their group, where they are: a shuffle by group would give a task a whole group.

    Beyond ``FEW_GROUPS`` groups, rows are shuffled; groups are then small beside the input, or left to the adaptive planner.
    """
    if not group:
        return df.crossJoin(F.broadcast(per_group))  # one row
    if not _large(df):
        return df.join(per_group, group)
    shared_folder(df.sparkSession)
    per_group = per_group.checkpoint()  # kept, as it is counted before it is sent
    few = per_group.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return df.join(F.broadcast(per_group) if few else per_group, group)


def ordered_means(df: DataFrame, by: list[str], order: list[str], **values: Column) -> DataFrame:
    """(by, n, names of ``values``): rows and means of each key, summed in a given order, with the bits of a serial average.

    A plain average adds in the order in which rows come in, so its last bits change from run to run, and with them
    which means tie and where a half is rounded to. One sort by key, and a running mean that holds no rows.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = df.select(*by, *order, *(v.alias(n) for n, v in values.items())).withColumn("_m", F.struct(F.count("*").over(w).alias("n"), *(F.avg(n).over(w).alias(n) for n in values)))
    return running.groupBy(*by).agg(F.max_by("_m", F.struct(*order)).alias("_m")).select(*by, "_m.*")


def running_counts(df: DataFrame, value: str, by: list[str], **also: Column) -> DataFrame:
    """(by, value, _times, _upto): how often each value occurs, and how many values are as large at most; ``also``: further aggregates of equal values.

    Equal values are counted first. Where many remain they are dealt out in ranges and sorted there; each range
    counts on from the ranges before it, so no task sees a whole group.
    """
    times = df.groupBy(*by, value).agg(F.count("*").alias("_times"), *(c.alias(n) for n, c in also.items()))
    if not _large(df):
        order = (Window.partitionBy(*by) if by else Window).orderBy(value)
        return times.withColumn("_upto", F.sum("_times").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    shared_folder(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # kept, as the ranges are looked at twice
    ranges = times.repartitionByRange(n, *by, value).withColumn("_part", F.spark_partition_id()).checkpoint()
    size = ranges.groupBy("_part", *by).agg(F.sum("_times").alias("_size"))
    order = (Window.partitionBy(*by) if by else Window).orderBy("_part")  # a row for each range
    before = size.withColumn("_before", F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    inner = Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranges.withColumn("_within", F.sum("_times").over(inner)).join(before, ["_part", *by]).select(*by, value, "_times", *also, (F.col("_before") + F.col("_within")).alias("_upto"))


def quantiles(df: DataFrame, group: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(group, quantiles) of finite values with linear interpolation, exact at any size."""
    counts = running_counts(df.filter(finite(value)), value, group)
    total = counts.groupBy(*group).agg(F.max("_upto").alias("_n"))
    joined = with_group(counts, total, group)
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_times") <= rank) & (rank < F.col("_upto")), F.col(value).cast("double")))
    place = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    ends = [x for q in shares for x in (at(F.floor(place(q))), at(F.ceil(place(q))))]
    got = joined.groupBy(*group).agg(F.max("_n").alias("_n"), F.array(*ends).alias("_v"))
    lerp = [F.col("_v")[2 * i] + (F.col("_v")[2 * i + 1] - F.col("_v")[2 * i]) * (place(q) - F.floor(place(q))) for i, q in enumerate(shares)]
    return got.select(*group, F.array(*lerp).alias("quantiles"))


def describe(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per group, over finite values: n, missing_n, mean, sd (0 for one value), median, q1, q3, min, max, skewness, outliers."""
    ok = F.when(finite(value), F.col(value).cast("double"))
    large = _large(df)
    quartiles = F.lit(None).cast("array<double>") if large else F.percentile(ok, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*group).agg(
        F.count(ok).alias("n"), F.count_if(ok.isNull()).alias("missing_n"), F.avg(ok).alias("mean"), F.when(F.count(ok) > 1, F.stddev_samp(ok)).when(F.count(ok) == 1, 0.0).alias("sd"),
        quartiles.alias("_q"), F.min(ok).alias("min"), F.max(ok).alias("max"), F.skewness(ok).alias("skewness"),
    )
    if large:  # an aggregate would hold all of a group's values
        q = quantiles(df, group, value, (0.25, 0.5, 0.75)).withColumnRenamed("quantiles", "_q")
        out = out.drop("_q")
        out = out.join(q, group, "left") if group else out.crossJoin(F.broadcast(q))  # one row
    out = out.select(*group, "n", "missing_n", "mean", "sd", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3"), "min", "max", "skewness")
    spread = F.col("q3") - F.col("q1")
    beyond = (F.col(value) < F.col("q1") - OUTLIER_IQR * spread) | (F.col(value) > F.col("q3") + OUTLIER_IQR * spread)
    if large:  # kept, as all rows are compared with it
        out = out.checkpoint()
    counted = with_group(df.select(*group, value), out.select(*group, "q1", "q3"), group).groupBy(*group).agg(F.count_if(finite(value) & beyond & (spread > 0)).alias("outliers"))
    return out.join(counted, group) if group else out.crossJoin(counted)


def rate_groups(df: DataFrame, rate: str, k: float = 0.0, keys: list[str] | None = None, few: str = "raise") -> DataFrame:
    """Adds log_rate, mean, sd, low, high (thresholds: mean -/+ k sd of log1p rates) and group; rates that aren't finite go.

    With k = 0 both thresholds are the mean, and only an exact tie is "mid". Fewer than two finite rates raise, or with
    ``few`` = "drop" their key goes.
    """
    keys = keys or []
    ok = df.filter(finite(rate)).withColumn("log_rate", F.log1p(rate))
    stats = ok.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("log_rate").alias("mean"), F.stddev_samp("log_rate").alias("sd"))
    if few == "drop":
        stats = stats.filter(F.col("_n") >= 2)
    stats = stats.withColumn("mean", F.when(F.col("_n") < 2, F.raise_error(F.lit("fewer than two finite rates"))).otherwise(F.col("mean"))).drop("_n")
    joined = with_group(ok, stats, keys)
    joined = joined.withColumn("low", F.col("mean") - k * F.col("sd")).withColumn("high", F.col("mean") + k * F.col("sd"))
    return joined.withColumn("group", F.when(F.col("log_rate") < F.col("low"), "low").when(F.col("log_rate") > F.col("high"), "high").otherwise("mid"))


def _sides(df: DataFrame, by: list[str], group: str, value: str, low: str, high: str, moments: bool = False) -> DataFrame:
    """Statistics of both sides as columns; ``moments``: only counts, means and deviations, in one pass."""
    both = df.filter(F.col(group).isin(low, high))
    if moments:
        ok = F.when(finite(value), F.col(value).cast("double"))
        d = both.groupBy(*by, group).agg(F.count(ok).alias("n"), F.avg(ok).alias("mean"), F.when(F.count(ok) > 1, F.stddev_samp(ok)).when(F.count(ok) == 1, 0.0).alias("sd"))
        columns = ["n", "mean", "sd"]
    else:
        d = describe(both, [*by, group], value)
        columns = ["n", "missing_n", "mean", "sd", "median", "q1", "q3", "min", "max", "skewness", "outliers"]
    pick = lambda side, c: F.max(F.when(F.col(group) == side, F.col(c))).alias(f"{c}_{'low' if side == low else 'high'}")
    return d.groupBy(*by).agg(*(pick(side, c) for side in (low, high) for c in columns))


def choose_test() -> Column:
    """mannwhitney for small, skewed or outlying samples, else welch; none below two values."""
    odd = lambda s: (F.col(f"n_{s}") < MIN_SIZE) | (F.abs(f"skewness_{s}") >= SKEW_LIMIT) | (F.col(f"outliers_{s}") > 0)
    few = (F.coalesce("n_low", F.lit(0)) < 2) | (F.coalesce("n_high", F.lit(0)) < 2)
    return F.when(few, "none").when(odd("low") | odd("high"), "mannwhitney").otherwise("welch")


def welch_t(sides: DataFrame) -> DataFrame:
    """Adds t and df (high less low) and hedges_g; null where they have no value."""
    a, b = F.pow("sd_high", 2) / F.col("n_high"), F.pow("sd_low", 2) / F.col("n_low")
    total = F.col("n_high") + F.col("n_low")
    pooled = F.sqrt(((F.col("n_high") - 1) * F.pow("sd_high", 2) + (F.col("n_low") - 1) * F.pow("sd_low", 2)) / F.nullif(total - 2, F.lit(0)))
    gap = F.col("mean_high") - F.col("mean_low")
    enough = (F.col("n_high") > 1) & (F.col("n_low") > 1)
    nonzero = lambda x: F.when(x > 0, x)
    return (
        sides.withColumn("t", F.when(enough, gap / F.sqrt(nonzero(a + b))))
        .withColumn("df", F.when(enough, F.pow(a + b, 2) / nonzero(F.pow(a, 2) / F.nullif(F.col("n_high") - 1, F.lit(0)) + F.pow(b, 2) / F.nullif(F.col("n_low") - 1, F.lit(0)))))
        .withColumn("hedges_g", F.when(enough, gap / nonzero(pooled) * (1 - 3 / (4 * total - 9))))
    )


def with_welch_p(tested: DataFrame) -> DataFrame:
    """Adds p, two-sided, of Welch's t and its degrees of freedom; null where there is no t."""
    ship(tested.sparkSession)

    @F.pandas_udf("double")
    def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([tails.t_two_sided(a, b) if a == a and a is not None and b == b and b is not None else None for a, b in zip(t, df, strict=True)], dtype="float64")

    return tested.withColumn("p", p_value("t", "df")).withColumn("p", F.when(~F.isnan("p"), F.col("p")))


def _midrank() -> Column:
    """The rank from 1 that a row of ``running_counts`` gives to each of its equal values."""
    return F.col("_upto") - (F.col("_times") - 1) / 2


def _ties() -> Column:
    """The sum of t^3 - t over the rows of ``running_counts``."""
    t = F.col("_times").cast("double")
    return F.sum(F.pow(t, 3) - t)


def midranks(df: DataFrame, value: str, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Ranks from 1 in which ties share their mean.

    Equal values are counted before ranking, so what is ranked has one row for each distinct value.
    """
    by = by or []
    ranked = running_counts(df, value, by).select(*by, value, _midrank().alias(out))
    return df.join(ranked, [*by, value])


def mann_whitney(df: DataFrame, group: str, value: str, low: str, high: str, by: list[str] | None = None, ties: bool = False) -> DataFrame:
    """Per key: n_low, n_high, u (of the high sample) and delta = 2u / (n_low n_high) - 1; ``ties``: also the sum of t^3 - t.

    Each distinct value is ranked once with the counts of both sides, so values needn't be found again by a join:
    those that an aggregate made may come out otherwise in their last bits when they are made again.
    """
    by = by or []
    counts = running_counts(df.filter(finite(value) & F.col(group).isin(low, high)), value, by, _high=F.count_if(F.col(group) == high))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = counts.groupBy(*by).agg(total(F.col("_times") - F.col("_high")).alias("n_low"), total(F.col("_high")).alias("n_high"), F.sum(F.when(F.col("_high") > 0, _midrank() * F.col("_high"))).alias("_r"), _ties().alias("ties"))
    u = F.col("_r") - F.col("n_high") * (F.col("n_high") + 1) / 2
    out = out.withColumn("u", u).withColumn("delta", 2 * F.col("u") / F.nullif(F.col("n_low") * F.col("n_high"), F.lit(0)) - 1)
    return out.select(*by, "n_low", "n_high", "u", "delta", *(["ties"] if ties else []))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: h with tie correction, groups and p (closed form for three groups, else null)."""
    ok = df.filter(finite(value))
    ranked = midranks(ok, value)
    each = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum("rank").alias("r"))
    ties = ok.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    total = each.agg(F.sum("n").cast("double").alias("n"), F.sum(F.pow("r", 2) / F.col("n")).alias("s"), F.count("*").alias("groups")).crossJoin(ties)
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (F.pow(n, 3) - n), F.lit(0.0))
    return total.select(h.alias("h"), "groups").withColumn("p", F.when(F.col("groups") == 3, F.exp(-F.col("h") / 2)))


def signed_ranks(df: DataFrame, difference: str, ties: bool = False) -> DataFrame:
    """One row: w_plus, w_minus, w, n (zeros dropped) and effect; ``ties``: also the sum of t^3 - t.

    As in ``mann_whitney`` each distinct size is ranked once, with the count of its positive differences.
    """
    d = df.filter(finite(difference) & (F.col(difference) != 0)).withColumn("_abs", F.abs(difference))
    counts = running_counts(d, "_abs", [], _plus=F.count_if(F.col(difference) > 0))
    plus, minus = F.col("_plus"), F.col("_times") - F.col("_plus")
    total = lambda c, zero: F.coalesce(F.sum(c), F.lit(zero))
    out = counts.agg(total(_midrank() * plus, 0.0).alias("w_plus"), total(_midrank() * minus, 0.0).alias("w_minus"), total(F.col("_times"), 0).alias("n"), total(plus - minus, 0).alias("_e"), F.coalesce(_ties(), F.lit(0.0)).alias("ties"))
    return out.select("w_plus", "w_minus", F.least("w_plus", "w_minus").alias("w"), "n", (F.col("_e") / F.nullif(F.col("n"), F.lit(0))).alias("effect"), *(["ties"] if ties else []))


def benjamini_hochberg(df: DataFrame, p: str, by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Adds q and significant; null and NaN p count for nothing. The tests of one family are few."""
    by = by or []
    usable = finite(p)
    w = Window.partitionBy(*by, usable)
    order = w.orderBy(p)
    step = F.col(p) * F.count("*").over(w) / F.row_number().over(order)
    out = df.withColumn("_s", F.when(usable, step)).withColumn("_n", F.row_number().over(order))
    q = F.least(F.lit(1.0), F.min("_s").over(w.orderBy("_n").rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    return out.withColumn("q", F.when(usable, q)).withColumn("significant", F.coalesce(F.col("q") < alpha, F.lit(False))).drop("_s", "_n")


def holm(df: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """Adds p_holm, the running maximum of min(1, p (m - rank + 1))."""
    by = by or []
    w = Window.partitionBy(*by)
    order = w.orderBy(p)
    step = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(w) - F.row_number().over(order) + 1))
    out = df.withColumn("_s", step).withColumn("_n", F.row_number().over(order))
    return out.withColumn("p_holm", F.max("_s").over(w.orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s", "_n")


def compare(df: DataFrame, group: str, parameters: list[str], low: str = "low", high: str = "high", alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """One row for each parameter: both sides' statistics, test, statistic, p, effect, q, significant.

    Statistics, ranks and effects are plans. p of Welch's t follows from t and its degrees of freedom. The exact
    p of a small Mann-Whitney sample needs the sample itself, which has at most MIN_SIZE values on its small side;
    larger samples use the normal approximation from u and the ties, which are aggregates as well.
    """
    by = by or []
    ship(df.sparkSession)
    ids = [*by, "parameter"]
    long = df.filter(F.col(group).isin(low, high)).select(*by, group, F.explode(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(p).alias("parameter"), F.col(p).cast("double").alias("value")) for i, p in enumerate(parameters)))).alias("_v")).select(*by, group, "_v.*")
    # kept, as statistics and ranks both look at the values, and those of an aggregate may come out otherwise each time
    shared_folder(df.sparkSession)
    long = long.checkpoint()
    sides = welch_t(_sides(long, [*ids, "position"], group, "value", low, high)).withColumn("test", choose_test())
    u = mann_whitney(long, group, "value", low, high, ids, ties=True).select(*ids, "u", "delta", "ties")
    out = sides.join(u, ids, "left")

    @F.pandas_udf("double")
    def p_value(test: pd.Series, t: pd.Series, d: pd.Series, u: pd.Series, n: pd.Series, m: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([tails.t_two_sided(a, b) if k == "welch" and a == a and a is not None else p_of_u(c, e, f, g) if k == "mannwhitney" else None for k, a, b, c, e, f, g in zip(test, t, d, u, n, m, ties, strict=True)], dtype="float64")

    out = out.withColumn("p", p_value("test", "t", "df", "u", "n_high", "n_low", "ties"))
    welch = F.col("test") == "welch"
    out = out.withColumn("statistic", F.when(welch, F.col("t")).when(F.col("test") == "mannwhitney", F.col("u"))).withColumn("effect", F.when(welch, F.col("hedges_g")).when(F.col("test") == "mannwhitney", F.col("delta")))
    return benjamini_hochberg(out.withColumn("p", F.when(~F.isnan("p"), F.col("p"))), "p", by, alpha).orderBy(*by, "position")


def p_of_u(u: float, n: float, m: float, ties: float) -> float:
    """Two-sided p of U: exact without ties and with at most 8 values in a sample, else normal with corrections."""
    n, m = int(n), int(m)
    if min(n, m) <= 8 and not ties:
        # any sample with this U has the same p: the ranks that give it
        ranks, rest = np.arange(1, n + 1, dtype=float), int(u)
        for k in range(n - 1, -1, -1):
            move = min(m, rest)
            ranks[k] += move
            rest -= move
        other = np.setdiff1d(np.arange(1, n + m + 1, dtype=float), ranks)
        return tails.mann_whitney(ranks, other)[1]
    total = n + m
    var = n * m / 12 * (total + 1 - ties / (total * (total - 1)))
    return 1.0 if var <= 0 else min(1.0, tails.normal_two_sided(max((max(u, n * m - u) - n * m / 2 - 0.5) / var**0.5, 0.0)))


def histogram(df: DataFrame, value: str, bins: int = 40, group: list[str] | None = None) -> DataFrame:
    """Counts and densities of equal bins between the extremes; the last bin holds its upper edge."""
    group = group or []
    ok = df.filter(finite(value))
    span = ok.groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("total"))
    joined = with_group(ok, span, group)
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return joined.withColumn("bin", at.cast("int")).groupBy(*group, "bin", "lo", "hi", "total").agg(F.count("*").alias("count")).withColumn("density", F.col("count") / F.nullif(F.col("total") * width, F.lit(0.0)))


def normal_fit(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of finite values and of their log1p: group, scale, n, mean, sd."""
    ok = df.filter(finite(value)).select(*(group or []), F.explode(F.array(F.struct(F.lit("raw").alias("scale"), F.col(value).cast("double").alias("x")), F.struct(F.lit("log1p").alias("scale"), F.log1p(F.col(value)).alias("x")))).alias("v"))
    return ok.groupBy(*(group or []), F.col("v.scale").alias("scale")).agg(F.count("v.x").alias("n"), F.avg("v.x").alias("mean"), F.stddev_pop("v.x").alias("sd"))


def sem(value: str) -> Column:
    """Standard error of the mean: 0 for one value, null for none."""
    return F.when(F.count(value) > 1, F.stddev_samp(value) / F.sqrt(F.count(value))).when(F.count(value) == 1, 0.0)


def normal_band(mean: Column, error: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Confidence band; no width for one value or none."""
    half = F.when(n > 1, z * error).otherwise(0.0)
    return mean - half, mean + half


def pairwise(df: DataFrame, group: str, value: str) -> DataFrame:
    """All pairs of a few groups (a < b): n_a, n_b, u of a, effect 1 - 2u / (n_a n_b), p of Mann-Whitney and p_holm, the smallest p first."""
    ship(df.sparkSession)
    ok = df.filter(finite(value)).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    names = ok.select("_g").distinct()
    both = names.select(F.col("_g").alias("a")).join(names.select(F.col("_g").alias("b")), F.col("a") < F.col("b"))
    # each row goes to the pairs of its group: as many as there are groups less one
    sides = both.select(F.explode(F.array("a", "b")).alias("_g"), "a", "b")
    long = ok.join(sides, "_g")
    ranked = midranks(long, "_v", ["a", "b"])
    ties = long.groupBy("a", "b", "_v").agg(F.count("*").cast("double").alias("t")).groupBy("a", "b").agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    first = F.col("_g") == F.col("a")
    out = ranked.groupBy("a", "b").agg(F.count_if(first).alias("n_a"), F.count_if(~first).alias("n_b"), F.sum(F.when(first, F.col("rank"))).alias("_r")).join(ties, ["a", "b"])
    out = out.withColumn("u", F.col("_r") - F.col("n_a") * (F.col("n_a") + 1) / 2).withColumn("effect", 1 - 2 * F.col("u") / (F.col("n_a") * F.col("n_b")))

    @F.pandas_udf("double")
    def p_value(u: pd.Series, n: pd.Series, m: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([p_of_u(*x) for x in zip(u, n, m, ties, strict=True)], dtype="float64")

    return holm(out.withColumn("p", p_value("u", "n_a", "n_b", "ties")).drop("_r", "ties"), "p").orderBy("p", "a", "b")


def paired(df: DataFrame, subject: str, first: str, second: str, digits: int | None = None) -> DataFrame:
    """One row: signed ranks of two metrics' means of each subject, both scaled by their mean over subjects; with p.

    Differences are rounded to ``digits`` if given, so that those equal but for their last bits tie.

    Subjects without a finite value of both go, and so does a metric's scaling where its mean is zero.
    """
    ship(df.sparkSession)
    means = df.groupBy(subject).agg(*(F.avg(F.when(finite(c), F.col(c))).alias(n) for c, n in ((first, "x"), (second, "y")))).filter("x is not null and y is not null")
    scale = means.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    scaled = means.crossJoin(F.broadcast(scale)).filter("mx <> 0 and my <> 0").withColumn("d", F.col("x") / F.col("mx") - F.col("y") / F.col("my"))  # one row
    if digits is not None:
        scaled = scaled.withColumn("d", F.round("d", digits))

    @F.pandas_udf("double")
    def p_value(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([p_of_w(*x) for x in zip(w, n, ties, strict=True)], dtype="float64")

    return signed_ranks(scaled, "d", ties=True).withColumn("p", p_value("w", "n", "ties")).drop("ties")


def p_of_w(w: float, n: float, ties: float) -> float:
    """Two-sided p of the smaller signed-rank sum: exact for at most 50 differences without ties, else normal."""
    n = int(n)
    if not n:
        return 1.0
    if n <= 50 and not ties:
        ways = np.ones(1)
        for k in range(1, n + 1):
            ways = np.append(ways, np.zeros(k)) + np.append(np.zeros(k), ways)
        return min(1.0, 2 * float(ways[: int(w) + 1].sum()) / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return min(1.0, tails.normal_two_sided((w - n * (n + 1) / 4) / var**0.5))


def parameter_values(df: DataFrame, keys: list[str], parameters: list[str]) -> DataFrame:
    """Long form for plots: keys, parameter, value."""
    return df.unpivot(keys, parameters, "parameter", "value")
