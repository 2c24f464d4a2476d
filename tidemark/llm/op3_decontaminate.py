"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every document and benchmark item is a sequence of words, and each word one hash. Hashes of runs of words
are made by joining shifted arrays: runs of 2 from single words, of 4 from runs of 2, and so on. For
winnowing the least of 7 adjoining hashes of runs of 4 words is kept at each place: both texts of a shared
span of 10 words keep the same one, so joining the kept fingerprints finds every document that may share
a window. In these documents the hits are extended: windows of the full length are compared by two hashes
of 64 bits, and each hit word is counted once. Items of fewer than 10 words are one window each, and the
fingerprints of their lengths are the runs of that many words.

Only the benchmark's fingerprints and windows are ever broadcast, and only if their counted number is
within BROADCAST_ROWS; beyond, the same joins shuffle.

Defined results: a null text has no words and isn't contaminated; items without words have no windows; a
null item_id hits words but isn't listed; rows with equal doc_id and text get equal results; an empty
benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder

#: Words in a window, in a winnowed run, and runs of which the least is kept.
WINDOW, RUN = 10, 4
LEAST_OF = WINDOW - RUN + 1
#: Most rows of the benchmark's side that are broadcast (32 bytes each).
BROADCAST_ROWS = 1_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAPS = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def words(text: Column) -> Column:
    """The words of a text, A-Z lowered."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _GAPS, _UPPER.lower() + " " * len(_GAPS))
    return F.array_remove(F.split(spaced, " "), "")


def _joined(left: str, right: str, shift: int, how) -> Column:
    """Joins each entry of one array with the entry of another that stands ``shift`` places on."""
    n = F.greatest(F.lit(0), F.least(F.size(left), F.size(right) - shift))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), how)


def _both(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def with_runs(df: DataFrame, lengths: set[int], salt: int = 0) -> DataFrame:
    """Adds run<n>_<salt>, the hashes of all runs of n words of the column ``words``, for each n wanted and those it is made of."""
    name = lambda n: f"run{n}_{salt}"
    if name(1) not in df.columns:
        df = df.withColumn(name(1), F.transform("words", lambda w: F.xxhash64(w, F.lit(salt)) if salt else F.xxhash64(w)))
    for n in sorted(lengths | {p for m in lengths for p in (2, 4, 8) if p <= m}):
        if name(n) in df.columns:
            continue
        half = max(p for p in (1, 2, 4, 8) if p < n)
        rest = n - half
        if name(rest) not in df.columns:
            df = with_runs(df, {rest}, salt)
        df = df.withColumn(name(n), _joined(name(half), name(rest), half, _both))
    return df


def with_least(df: DataFrame) -> DataFrame:
    """Adds least7: at each place the least of LEAST_OF adjoining hashes of runs of RUN words."""
    df = with_runs(df, {RUN})
    df = df.withColumn("least2", _joined(f"run{RUN}_0", f"run{RUN}_0", 1, _least))
    df = df.withColumn("least4", _joined("least2", "least2", 2, _least))
    return df.withColumn("least7", _joined("least4", "least4", LEAST_OF - 4, _least))


def _fingerprints(df: DataFrame, short: list[int]) -> tuple[DataFrame, Column]:
    df = with_least(df)
    parts = [F.array_distinct("least7")]
    if short:
        df = with_runs(df, set(short))
        parts += [F.array_distinct(f"run{n}_0") for n in short]
    return df, F.concat(*parts) if len(parts) > 1 else parts[0]


def _placed(n: int) -> Column:
    both = F.zip_with(f"run{n}_0", f"run{n}_1", lambda a, b: F.struct(a.alias("h"), b.alias("g")))
    return F.transform(both, lambda x, i: F.struct(F.lit(n).alias("length"), i.alias("place"), x["h"].alias("h"), x["g"].alias("g")))


def _windows(df: DataFrame, lengths: list[int]) -> tuple[DataFrame, Column]:
    """Structs of length, place and two hashes for all windows of these lengths."""
    df = with_runs(with_runs(df, set(lengths)), set(lengths), 1)
    each = [_placed(n) for n in lengths]
    return df, F.concat(*each) if len(each) > 1 else each[0]


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint where the counted rows are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    every, hits, windows = _hits(docs.select("doc_id", "text"), benchmark)
    hits = hits.checkpoint()  # a row for each window of a leak
    doc = Window.partitionBy("_doc", "_text").orderBy("place", "length")
    before = F.coalesce(F.max(F.col("place") + F.col("length")).over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("place") + F.col("length") - F.greatest("place", before))
    covered = hits.select("_doc", "_text", fresh.alias("fresh")).groupBy("_doc", "_text").agg(F.sum("fresh").cast("long").alias("n_hit"))
    # items by lists of a window, and lists by documents: a window of many items in many documents makes no product of both
    lists = windows.groupBy("length", "h", "g").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("list", F.struct(F.xxhash64("items").alias("a"), F.xxhash64("items", F.lit(1)).alias("b")))
    held = hits.select("_doc", "_text", "length", "h", "g").distinct().join(_small(lists.select("length", "h", "g", "list")), ["length", "h", "g"])
    held = held.groupBy("_doc", "_text").agg(F.sort_array(F.collect_set("list")).alias("lists"))
    names = lists.select("list", "items").dropDuplicates(["list"])
    named = held.select("lists").distinct().select("lists", F.explode("lists").alias("list")).join(names, "list").select("lists", F.explode("items").alias("item"))
    named = named.groupBy("lists").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.col("lists").alias("_lists"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("sha"))
    held = held.join(named, F.col("lists") == F.col("_lists"), "left").select(F.col("_doc").alias("_hd"), F.col("_text").alias("_ht"), "n_items", "sha")
    found = covered.join(held, F.col("_doc").eqNullSafe(F.col("_hd")) & (F.col("_text") == F.col("_ht"))).select(F.col("_doc").alias("_d"), F.col("_text").alias("_t"), "n_hit", "n_items", "sha")
    joined = every.join(found, every["_doc"].eqNullSafe(found["_d"]) & (every["_text"] == found["_t"]), "left")
    each = joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return each.select(
        F.col("_doc").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no window with the benchmark, columns as they were."""
    hit = _hits(docs.select("doc_id", "text"), benchmark)[1].select("_doc", "_text").distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_doc"]) & (_text_key(docs["text"]) == hit["_text"]), "left_anti")


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents (_doc, _text, n_words, copies); each window of one that the benchmark holds (_doc, _text, place, length, h, g); and the items' windows.

    One pass over the texts counts words and finds the documents that share a fingerprint; its small result is
    kept, and only those documents' texts are read again.
    """
    shared_folder(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    # lengths of items under a window: nine at most
    short = sorted(r[0] for r in items.filter(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct().collect())
    lengths = [*short, WINDOW]
    marked, prints = _fingerprints(items, short)
    wanted = F.when(F.size("words") >= WINDOW, F.array_distinct("least7"))
    for n in short:
        wanted = wanted.when(F.size("words") == n, F.col(f"run{n}_0"))
    bench_prints = _small(marked.select(F.explode(wanted).alias("print")).distinct().withColumn("_shared", F.lit(True)))
    marked, every = _windows(items, lengths)
    own = marked.select("item_id", F.least(F.size("words"), F.lit(WINDOW)).alias("own"), F.explode(every).alias("at"))
    windows = own.filter("at.length = own").select("item_id", "at.length", "at.h", "at.g").distinct()

    keyed = docs.select(F.col("doc_id").alias("_doc"), _text_key(F.col("text")).alias("_text"), "text")
    found, prints = _fingerprints(keyed.withColumn("words", words(F.col("text"))), short)
    # the entry at place 0 is the document itself: its text's hash stands for it and spreads like the others
    found = found.select("_doc", "_text", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array("_text"), prints)).alias("_at", "print"))
    found = found.join(bench_prints, "print", "left").groupBy("_doc", "_text", "n_words").agg(F.count_if(F.col("_at") == 0).alias("copies"), F.coalesce(F.bool_or("_shared"), F.lit(False)).alias("_near")).checkpoint()
    close = found.filter("_near").select(F.col("_doc").alias("_fd"), F.col("_text").alias("_ft"))
    near = keyed.join(close, keyed["_doc"].eqNullSafe(close["_fd"]) & (keyed["_text"] == close["_ft"]), "left_semi")
    near, every = _windows(near.withColumn("words", words(F.col("text"))), lengths)
    near = near.select("_doc", "_text", F.explode(every).alias("at")).select("_doc", "_text", "at.*")
    hits = near.join(_small(windows.select("length", "h", "g").distinct()), ["length", "h", "g"], "left_semi").distinct()
    return found.drop("_near"), hits, windows
