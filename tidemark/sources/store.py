"""A table whose rows are replaced by key, without rewriting anybody else's.

Every write adds a folder of its own and never touches another's. What it replaces (keys, or keys within a
scope such as a stage) goes to a log beside it, and a numbered commit file makes both visible at once. Readers
see committed runs only, less the rows of keys that a later commit replaced::

    path/run=<id>/[stage=../]bucket=../part-*    rows
    path/_log/run=<id>/part-*                    the keys that the run replaces, with or without new rows
    path/_commits/<number>-<id>                  the run, its schema and what was counted as it was written

So a write that breaks off leaves what was there; writers of different keys may run at once, and of the same
keys the later commit wins (of two made at once, whose numbers may be equal, that with the larger id). The rows of a key share a bucket by its hash, which prunes reads of one key. Only
numbers of commits and their file names come to the driver. A folder without commits is read as a plain table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove


@dataclass(frozen=True)
class Commit:
    """One write: its name, which gives the order of all, its run, its rows' schema, its figures, and the runs that it replaces as a whole, if any."""

    name: str
    run: str
    schema: T.StructType
    figures: dict[str, int]
    covers: list[str] | None = None

    @property
    def rows(self) -> int:
        return self.figures["rows"]


def _observed(seen: Observation, names: list[str]) -> dict:
    """The figures of a write; an optimiser that finds the rows to be none drops the observation with them."""
    try:
        return seen.get
    except Py4JJavaError:
        return dict.fromkeys(names, 0)


class Store:
    """Rows by ``key`` at a path; with ``scope`` a key is replaced within one value of that column at a time."""

    def __init__(self, spark: SparkSession, path: str, key: str, scope: str | None = None, fmt: str = "parquet", buckets: int = 8):
        self.spark, self.path, self.key, self.scope, self.fmt, self.buckets = spark, path.rstrip("/"), key, scope, fmt, buckets

    @property
    def keys(self) -> list[str]:
        return [self.key, *([self.scope] if self.scope else [])]

    @property
    def parts(self) -> list[str]:
        return [*([self.scope] if self.scope else []), "bucket"]

    def _at(self, below: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def _files(self, below: str) -> list:
        at = self._at(below)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return list(fs.listStatus(at)) if fs.exists(at) else []

    def _names(self) -> list[str]:
        return sorted(n for s in self._files("_commits") if (n := s.getPath().getName())[0] not in "_.")

    def history(self) -> list[Commit]:
        """All commits in their order; small files, one for each write."""
        if not (names := self._names()):
            return []
        rows = self.spark.read.option("wholetext", True).text([f"{self.path}/_commits/{n}" for n in names]).select(F.col("_metadata.file_name").alias("n"), "value").collect()
        told = [(r.n, json.loads(r.value)) for r in rows]
        return sorted((Commit(n, x["run"], T.StructType.fromJson(x["schema"]), x["figures"], x["covers"]) for n, x in told), key=lambda c: c.name)

    def commits(self) -> list[Commit]:
        """The commits that count, in the order in which they replace each other.

        One that replaced whole runs comes first: it stands for them, and what it hadn't seen came after. Of two that
        replaced the same run, as when two compact a table at once, the later says nothing new.
        """
        covered: set[str] = set()
        vain: set[str] = set()
        for c in (every := self.history()):
            if c.covers is not None:
                vain |= {c.run} if covered & set(c.covers) else set()
                covered |= set(c.covers)
        return sorted((c for c in every if c.run not in covered | vain), key=lambda c: (c.covers is None, c.name))

    def _commit(self, run: str, schema: T.StructType, figures: dict[str, int], covers: list[str] | None) -> Commit:
        """Makes a run visible: a whole file appears under a name of its own, or none does."""
        fs = self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())
        number = max((int(n.split("-")[0]) for n in self._names()), default=0) + 1
        name, passing = f"{number:012d}-{run}", self._at(f"_commits/_{run}")
        out = fs.create(passing, True)
        out.write(bytearray(json.dumps({"run": run, "schema": schema.jsonValue(), "figures": figures, "covers": covers}).encode()))
        out.close()
        if not fs.rename(passing, self._at(f"_commits/{name}")):
            raise RuntimeError(f"can't commit to {self.path}")
        return Commit(name, run, schema, figures, covers)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, replaced: DataFrame | None = None, whole: bool = False, figures: dict[str, Column] | None = None) -> Commit:
        """Adds rows in place of all earlier rows of the keys in ``replaced`` and of their own; ``whole`` replaces all that was there when it began.

        The rows are evaluated once: their number, and more ``figures`` (aggregates), are observed as they are written.
        """
        covers = [c.run for c in self.commits()] if whole else None
        run, seen = uuid.uuid4().hex, Observation()
        rows = rows.drop(*(c for c in ("run", "bucket") if c in rows.columns))
        schema = rows.schema
        dealt = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in (figures or {}).items())).withColumn("bucket", self.bucket(F.col(self.key)))
        folder = f"{self.path}/run={run}"
        dealt.hint("rebalance", *self.parts).write.partitionBy(*self.parts).format(self.fmt).option("header", True).save(folder)
        counted = {k: int(v or 0) for k, v in _observed(seen, ["rows", *(figures or {})]).items()}
        own = None if whole else self._read([folder], schema, ["bucket"]).select(*self.keys) if counted["rows"] else None
        sets = [x.select(*(F.col(k).cast(schema[k].dataType) for k in self.keys)) for x in (own, replaced) if x is not None]
        if sets and not whole:
            both = sets[0] if len(sets) == 1 else sets[0].unionByName(sets[1])
            both.distinct().write.parquet(f"{self.path}/_log/run={run}")
        return self._commit(run, schema, counted, covers)

    def _read(self, folders: list[str], schema: T.StructType, more: list[str]) -> DataFrame:
        full = T.StructType([*schema.fields, *(T.StructField(c, T.IntegerType() if c == "bucket" else T.StringType()) for c in more)])
        return self.spark.read.schema(full).option("basePath", self.path).option("header", True).format(self.fmt).load(folders)

    def replaced(self, commits: list[Commit]) -> DataFrame | None:
        """(run, keys) that a later commit replaced; none if no two commits share a key."""
        there = {s.getPath().getName() for s in self._files("_log")}
        logged = [c for c in commits if f"run={c.run}" in there]
        if len(commits) < 2 or not logged:
            return None
        kinds = commits[-1].schema
        schema = T.StructType([*(T.StructField(k, kinds[k].dataType) for k in self.keys), T.StructField("run", T.StringType())])
        log = self.spark.read.schema(schema).option("basePath", f"{self.path}/_log").parquet(*(f"{self.path}/_log/run={c.run}" for c in logged))
        order = self.spark.createDataFrame([(c.run, i) for i, c in enumerate(commits)], "run string, number long")  # a row for each write
        placed = log.join(F.broadcast(order), "run")
        last = placed.groupBy(*self.keys).agg(F.max("number").alias("last"), F.collect_list(F.struct("run", "number")).alias("runs"))
        older = last.select(*self.keys, "last", F.explode("runs").alias("r")).filter("r.number < last").select(*self.keys, F.col("r.run").alias("run"))
        if commits[0].covers is not None:  # it has no log of its own: what came later replaces its rows
            older = older.unionByName(last.select(*self.keys, F.lit(commits[0].run).alias("run")))
        return older.distinct()

    def read(self, key: str | None = None) -> DataFrame | None:
        """The rows that hold now; of one key only its bucket is opened. None if nothing was ever written."""
        commits = self.commits()
        if not commits:
            return None
        fields: dict[str, T.StructField] = {}
        for c in commits:
            fields |= {f.name: T.StructField(f.name, f.dataType) for f in c.schema}
        schema = T.StructType(list(fields.values()))
        folders = [f"{self.path}/run={c.run}" for c in commits if c.rows]
        if not folders:
            return self.spark.createDataFrame([], schema)
        out = self._read(folders, schema, ["bucket", "run"])
        if key is not None:
            out = out.filter((F.col("bucket") == self.bucket(F.lit(key))) & (F.col(self.key) == key))
        if (gone := self.replaced(commits)) is not None:
            if key is not None:
                gone = gone.filter(F.col(self.key) == key)
            names = [*self.keys, "run"]
            gone = gone.select(*(F.col(k).alias(f"_{k}") for k in names))
            # rows stay where they are if what was replaced is small enough to be sent to them
            out = out.join(gone, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names], "left_anti")
        return out.select(*schema.names)

    def compact(self) -> Commit | None:
        """All rows that hold now as one run; earlier runs can then be cleared away. Writers may go on meanwhile."""
        now = self.read()
        return None if now is None else self.write(now, whole=True)

    def clear(self, uncommitted: bool = False) -> list[str]:
        """Deletes runs that a commit of everything replaced; and those without a commit, when no writer is at work."""
        held, told = {c.run for c in self.commits()}, {c.run for c in self.history()}
        found = [s.getPath().getName().removeprefix("run=") for s in self._files("") if s.getPath().getName().startswith("run=")]
        gone = [r for r in found if r not in held and (r in told or uncommitted)]
        for r in gone:
            remove(self.spark, f"{self.path}/run={r}")
            remove(self.spark, f"{self.path}/_log/run={r}")
        return gone


def read_rows(spark: SparkSession, path: str, key: str, scope: str | None = None, fmt: str = "parquet") -> DataFrame:
    """The rows of a store, or of a plain table where there are no commits."""
    found = Store(spark, path, key, scope, fmt).read()
    return spark.read.format(fmt).option("header", True).load(path) if found is None else found
