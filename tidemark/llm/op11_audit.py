"""Audit of how five filters interact, by Walsh-Hadamard sums.

A document's failures are the bits of a mask: A few words, B few different words, C many capitals, D symbols,
E a text that a smaller doc_id holds. For each part and label, 32 parity sums add every document with the sign
of the parity of ``mask & w``: they are sums, so Spark adds them before its shuffle, and their inverse gives
the exact number of documents of each mask. All that any order of filters does follows from these 32 numbers:
what passes a set of filters is a sum over the masks outside it, and a filter's share over all 120 orders is
120 / (number of failures), as each of a document's failures comes first equally often.

Copies need no window: rows of a text, part and label are counted before they meet, those at the smallest
doc_id apart, so a text that a third of all rows hold is a few rows.

Defined results: a null or empty text has no words and no characters, so it fails A and neither B, C nor D; null texts are
copies of empty ones; a row without a doc_id is no copy and makes none; rows that repeat a doc_id with one
text are no copies of each other; a document with several labels is good or toxic if any of them says so; a
null source is the part of the empty string; no documents, no rows.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Least words, least share of different words and most share of capitals, in hundredths.
LEAST_WORDS, DIFFERENT, CAPITALS = 200, 50, 2


def failures(text: Column) -> Column:
    """The mask of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    many, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [many < LEAST_WORDS, 100 * different < DIFFERENT * many, 100 * capitals > CAPITALS * F.length(text), text.rlike("[#$%&*|]")]
    return reduce(lambda a, b: a + b, [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)])


def _parity(w: int) -> str:
    """Adds the rows at a text's smallest doc_id, which pass E, and the others, which fail it."""
    sign = "(1 - 2 * (bit_count({mask} & {w}) % 2))"
    return f"sum({sign.format(mask='mask', w=w)} * first + {sign.format(mask='(mask + 16)', w=w)} * later)"


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, sums): the 32 parity sums of each part and label."""
    shared_folder(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), failures(text).alias("mask"))
    each = facts.groupBy("doc_id", "part", "same", "mask").agg(F.count("*").alias("n"))  # repeated rows meet here
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    # rows without a doc_id find no label: keys by their texts spread them
    each = each.withColumn("_key", F.coalesce("doc_id", F.xxhash64("same")))
    each = each.join(marks, (F.col("_key") == F.col("_doc")) & F.col("doc_id").isNotNull(), "left")
    each = each.withColumns({"good": F.coalesce("_good", F.lit(False)), "toxic": F.coalesce("_toxic", F.lit(False))})
    without = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    groups = each.groupBy("same", "part", "good", "toxic", "mask").agg(F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum("n").alias("n"), without.alias("none")).checkpoint()
    first = groups.groupBy(F.col("same").alias("_same")).agg(F.min("least").alias("_least"))
    met = groups.join(first, F.col("same") == F.col("_same"))
    at_first = F.col("none") + F.when(F.col("least") == F.col("_least"), F.col("at_least")).otherwise(0)
    met = met.select("part", "good", "toxic", "mask", at_first.alias("first"), (F.col("n") - at_first).alias("later"))
    return met.groupBy("part", "good", "toxic").agg(F.expr(f"array({', '.join(map(_parity, range(CELLS)))})").alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """(part, cells): the documents of each mask, all, good and toxic, by the inverse: the same signs again, over 32."""
    masks = F.sequence(F.lit(0), F.lit(CELLS - 1))
    df = sums.select("part", "good", "toxic", "sums", F.explode(masks).alias("mask"))
    signed = F.zip_with("sums", masks, lambda s, w: s * (1 - 2 * (F.bit_count(w.bitwiseAND(F.col("mask"))) % 2)))
    df = df.withColumn("n", (F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x) / CELLS).cast("long"))
    counted = [F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name) for name, when in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))]
    return df.groupBy("part", "mask").agg(*counted).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))


def _passing(name: str) -> Column:
    """For each set of filters, the documents that pass them all."""
    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda s: F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(c["mask"].bitwiseAND(s) == 0, c[name]).otherwise(0)))


def _share(a: Column, c: Column, bit: Column) -> Column:
    return a + F.when(c["mask"].bitwiseAND(bit) != 0, c["n"] * F.lit(len(ORDERS)) / F.bit_count(c["mask"])).otherwise(0).cast("long")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    bits = {f: 1 << k for k, f in enumerate(FILTERS)}
    shares = F.transform(F.lit(list(bits.values())), lambda bit: F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: _share(a, c, bit)))
    df = cells(counts(docs, labels)).select("part", "cells", *[_passing(c).alias(name) for c, name in (("n", "left"), ("good", "good"), ("toxic", "toxic"))], shares.alias("shares"))
    steps = [{"filter_order": o, "step": k + 1, "before": sum(bits[x] for x in o[:k]), "bit": bits[f], "at": FILTERS.index(f)} for o in ORDERS for k, f in enumerate(o)]
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, before: int, bit: int, at: int>>")
    df = df.withColumn("s", F.explode(listed)).select("*", "s.*")
    after = F.col("before") + F.col("bit")
    lost = lambda c: F.col(c)[F.col("before")] - F.col(c)[after]
    failing = F.col("left")[0] - F.col("left")[F.col("bit")]
    out = {"kept": F.col("left")[after], "removed": lost("left"), "redundant": failing - lost("left"), "unique_fails": F.col("cells")[F.col("bit")]["n"], "good_lost": lost("good"), "toxic_lost": lost("toxic"), "shapley": F.col("shares")[F.col("at")]}
    return df.select("part", "filter_order", "step", *[c.cast("long").alias(k) for k, c in out.items()])
