"""Joins, unions and keyed selections of subjects, files and channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import is_nan
from ..session import shared_folder


def coalesce_union(frames: list[DataFrame], key: str) -> DataFrame:
    """One row for each key, sorted: each column's first value that is neither null nor NaN, in the frames' order.

    Rows within a frame have no order of their own; ties take the smallest value, so results are repeatable.
    """
    values = [c for c in frames[0].columns if c != key]
    ranked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)])

    def first(c: str) -> Column:
        usable = F.col(c).isNotNull() & ~is_nan(c) if dict(frames[0].dtypes)[c] in ("float", "double") else F.col(c).isNotNull()
        return F.min(F.when(usable, F.struct("_rank", c)))[c].alias(c)

    return ranked.filter(F.col(key).isNotNull()).groupBy(key).agg(*map(first, values)).orderBy(key)


def with_files(subjects: DataFrame, files: list[tuple[DataFrame, str]], key: str = "ID") -> DataFrame:
    """Subjects for which every listing (name) has a file named key + suffix."""
    for names, suffix in files:
        listed = names.select(F.col("name").alias("_name")).distinct()
        subjects = subjects.join(listed, F.concat(F.col(key), F.lit(suffix)) == F.col("_name"), "left_semi")
    return subjects


def availability(subjects: DataFrame, files: list[tuple[DataFrame, str, str]], key: str = "ID") -> DataFrame:
    """One row: subjects, those with each kind of file (names, suffix, column) and those with all."""
    for names, suffix, column in files:
        listed = names.select(F.col("name").alias("_name"), F.lit(True).alias(f"_{column}")).distinct()
        subjects = subjects.join(listed, F.concat(F.col(key), F.lit(suffix)) == F.col("_name"), "left").drop("_name")
    flags = [F.coalesce(F.col(f"_{c}"), F.lit(False)) for _, _, c in files]
    every = reduce(lambda a, b: a & b, flags)
    return subjects.agg(F.count("*").alias("metadata"), *(F.count_if(f).alias(c) for f, (_, _, c) in zip(flags, files, strict=True)), F.count_if(every).alias("valid"))


def pending(tasks: DataFrame, done: DataFrame, key: str = "ID", needed: int | None = None) -> DataFrame:
    """Tasks whose key isn't done; a key with ``needed`` parts is done when all of them are valid."""
    if needed is not None:
        done = done.groupBy(key).agg(F.count_if("valid").alias("_n")).filter(F.col("_n") >= needed)
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def shard(df: DataFrame, key: str, index: int, count: int) -> DataFrame:
    """Every count-th row in the order of a key, from ``index`` on.

    Rows are numbered without one task for all of them: partitions of the sorted rows are counted, and each
    adds the counts before its own.
    """
    ordered = df.orderBy(key).withColumn("_part", F.spark_partition_id())
    shared_folder(df.sparkSession)
    # kept, as partitions may be put together otherwise when they are counted
    numbered = ordered.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(key))).checkpoint()
    sizes = numbered.groupBy("_part").agg(F.max("_n").alias("_size"))  # a row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    numbered = numbered.join(F.broadcast(before), "_part")
    return numbered.filter((F.col("_n") + F.col("_before") - 1) % count == index).drop("_part", "_n", "_before")


def pairs(df: DataFrame, key: str, most: int = 2_000) -> DataFrame:
    """All unordered pairs of a few distinct values, such as stages; more than ``most`` values raise."""
    one = df.select(F.col(key).alias("a")).distinct()
    if (n := one.limit(most + 1).count()) > most:
        raise ValueError(f"over {n - 1} values have too many pairs")
    return one.join(one.select(F.col("a").alias("b")), F.col("a") < F.col("b"))


def key_differences(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected rows that aren't present."""
    return expected.select(*expected.columns).exceptAll(present.select(*expected.columns)).distinct()


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``duplicated``: whether another row has the same keys; every copy is marked."""
    return df.withColumn("duplicated", F.count("*").over(Window.partitionBy(*keys)) > 1)


def resolve_channels(available: DataFrame, aliases: list[tuple[str, list[str]]], subject: str = "subject_id", label: str = "label", ignore_case: bool = True, position: str | None = None, strict: bool = False) -> DataFrame:
    """Per subject: resolved (canonical to physical), missing, conflicts (canonical, alias, physical, claimed_by) and unresolved.

    Canonical names are taken in order, and of each its aliases in order: the first present label that isn't claimed
    yet is claimed. Each alias before it whose label is claimed is a conflict. A canonical name without a present
    label is missing; one without a label of its own, whether missing or not, is unresolved, which raises if
    ``strict``. Of labels that are alike the first by ``position`` counts, or by text without one. Labels of a subject
    are few, so the greedy claim is a fold over the sorted alias list.
    """
    norm = (lambda c: F.lower(F.trim(c))) if ignore_case else (lambda c: F.trim(c))
    order = F.struct(F.col(position) if position else F.lit(0), F.col(label).alias("_label"))
    labels = available.groupBy(subject).agg(F.transform(F.array_sort(F.collect_set(order)), lambda x: x["_label"]).alias("_labels"))
    physical = F.map_from_entries(F.transform(F.array_distinct(F.transform("_labels", norm)), lambda n: F.struct(n.alias("k"), F.element_at(F.filter("_labels", lambda x: norm(x) == n), 1).alias("v"))))
    alias_key = (lambda a: a.strip().casefold()) if ignore_case else str.strip
    table = F.array(*(F.struct(F.lit(c).alias("canonical"), F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(alias_key(a)).alias("key")) for a in names)).alias("aliases")) for c, names in aliases))
    found = "array<struct<canonical:string,alias:string,physical:string,claimed_by:string>>"

    def claim(state: Column, entry: Column) -> Column:
        own = lambda a: F.element_at(F.col("_physical"), a["key"])
        claimed = lambda a: F.exists(state["resolved"], lambda r: r["physical"] == own(a))
        present = F.filter(entry["aliases"], lambda a: F.map_contains_key(F.col("_physical"), a["key"]))
        pick = F.try_element_at(F.filter(present, lambda a: ~claimed(a)), F.lit(1))
        got = F.struct(entry["canonical"].alias("canonical"), pick["alias"].alias("alias"), F.try_element_at(F.col("_physical"), pick["key"]).alias("physical"), F.lit(None).cast("string").alias("claimed_by"))
        # aliases tried before the one that is claimed, or all if none is
        tried = F.when(pick.isNull(), present).otherwise(F.slice(present, F.lit(1), F.greatest(F.array_position(present, pick).cast("int") - 1, F.lit(0))))
        owner = lambda a: F.try_element_at(F.filter(state["resolved"], lambda r: r["physical"] == own(a)), F.lit(1))["canonical"]
        clashes = F.transform(tried, lambda a: F.struct(entry["canonical"].alias("canonical"), a["alias"].alias("alias"), own(a).alias("physical"), owner(a).alias("claimed_by")))
        add = lambda name, cond: F.when(cond, F.concat(state[name], F.array(entry["canonical"]))).otherwise(state[name]).alias(name)
        return F.struct(
            F.when(pick.isNotNull(), F.concat(state["resolved"], F.array(got))).otherwise(state["resolved"]).alias("resolved"),
            add("missing", F.size(present) == 0),
            F.concat(state["conflicts"], clashes).alias("conflicts"),
            add("unresolved", pick.isNull()),
        )

    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast(found).alias("resolved"), none.alias("missing"), F.array().cast(found).alias("conflicts"), none.alias("unresolved"))
    out = labels.withColumn("_physical", physical).withColumn("_claim", F.aggregate(table, start, claim))
    as_map = F.map_from_entries(F.transform("_claim.resolved", lambda r: F.struct(r["canonical"], r["physical"])))
    left = F.col("_claim.unresolved")
    if strict:
        left = F.when(F.size(left) > 0, F.raise_error(F.concat(F.lit("no channel for "), F.array_join(left, ", ")))).otherwise(left)
    return out.select(subject, as_map.alias("resolved"), F.col("_claim.missing").alias("missing"), F.col("_claim.conflicts").alias("conflicts"), left.alias("unresolved"))
