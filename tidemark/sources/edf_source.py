"""EDF recordings as a data source that reads byte ranges.

``spark.dataSource.register(EdfSource)`` gives ``spark.read.format("edf").load(folder)``: rows (subject_id, channel,
sf, block, start, samples), a row for each channel and ``blockSeconds`` of a file, so a night of any size is
many rows and no file is ever one value. Filters on subject_id prune files by their names, on channel the
channels, and on block or start the data records, before anything but a header is read; the session setting
``spark.sql.python.filterPushdown.enabled``, which ``scan`` makes, sends them here. Options of the same meaning are
``subjects``, ``channels``, ``from`` and ``to``. A partition is a run of blocks of a file, or several small files.

Paths on the machine are opened as files, others by the store's own client in Arrow; both seek. A file that can't be
read raises, or with the option ``errors`` = "rows" is a row whose ``problem`` says why.
"""

from __future__ import annotations

import os
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .edf import parse_header
from .errors import EDFFileNotFoundError, SourceError

#: Bytes of files that one partition reads, about, and seconds of a row.
PARTITION_BYTES, BLOCK_SECONDS = 128 << 20, 600.0
SCHEMA = "subject_id string, channel string, sf double, block int, start double, samples array<double>, problem string"
ANNOTATIONS = "EDF Annotations"


def opened(path: str):
    """A file's handle with read and seek."""
    scheme = urllib.parse.urlsplit(path).scheme
    if scheme in ("", "file"):
        return open(path.removeprefix("file://").removeprefix("file:"), "rb")
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of all EDF files below a folder, or of the one file."""
    scheme = urllib.parse.urlsplit(path).scheme
    store, at = (fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")) if scheme in ("", "file") else fs.FileSystem.from_uri(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise EDFFileNotFoundError(f"no folder or file {path}")
    found = store.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
    prefix = "" if scheme in ("", "file") else path[: len(path) - len(at)] if path.endswith(at) else f"{scheme}://"
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".edf"))


def header(file) -> dict:
    """A file's header, read by itself."""
    first = file.read(256)
    try:
        size = int(first[184:192])
    except ValueError as problem:
        raise SourceError(f"not an EDF header: {problem}") from problem
    return parse_header(first + file.read(max(0, size - 256)))


@dataclass
class Wanted:
    """What the filters leave: subjects and channels (None: all) and seconds from and to."""

    subjects: set[str] | None = None
    channels: set[str] | None = None
    begin: float = 0.0
    end: float = float("inf")

    def only(self, name: str, values: set[str]) -> None:
        now = getattr(self, name)
        setattr(self, name, values if now is None else now & values)


@dataclass
class Part(InputPartition):
    """Files of a partition, each with the share (k of n) of its blocks that the partition reads."""

    files: list[tuple[str, int, int]]

    def __init__(self, files):
        super().__init__(0)
        self.files = files


def subject_of(path: str) -> str:
    return os.path.basename(path).removesuffix(".edf")


def blocks(path: str, k: int, n: int, wanted: Wanted, seconds: float) -> Iterator[tuple]:
    """Rows of a file's share: only the wanted channels' bytes of the wanted records are read."""
    with opened(path) as file:
        h = header(file)
        width = sum(h["samples"])
        if not width or not h["seconds"]:
            return
        file.seek(0, os.SEEK_END)
        there = (file.tell() - h["header_bytes"]) // (2 * width)
        records = there if h["records"] < 0 else min(h["records"], there)
        per = max(1, round(seconds / h["seconds"]))  # records of a block
        count = -(-records // per)
        at = np.append(0, np.cumsum(h["samples"]))
        chosen = [i for i, label in enumerate(h["labels"]) if label != ANNOTATIONS and h["samples"][i] and (wanted.channels is None or label in wanted.channels)]
        for b in range(count * k // n, count * (k + 1) // n):
            start, stop = b * per * h["seconds"], min((b + 1) * per, records) * h["seconds"]
            if stop <= wanted.begin or start > wanted.end:
                continue
            many = min(per, records - b * per)
            whole = len(chosen) > 1 and 2 * sum(h["samples"][i] for i in chosen) > width
            if whole:  # most of each record: one read
                file.seek(h["header_bytes"] + 2 * width * b * per)
                body = np.frombuffer(file.read(2 * width * many), "<i2").reshape(many, width)
            for i in chosen:
                if whole:
                    raw = body[:, at[i] : at[i + 1]].ravel()
                else:
                    parts = []
                    for r in range(b * per, b * per + many):
                        file.seek(h["header_bytes"] + 2 * (width * r + int(at[i])))
                        parts.append(file.read(2 * h["samples"][i]))
                    raw = np.frombuffer(b"".join(parts), "<i2")
                span = h["digital_high"][i] - h["digital_low"][i]
                gain = (h["high"][i] - h["low"][i]) / span if span else 1.0
                yield subject_of(path), h["labels"][i], h["samples"][i] / h["seconds"], b, start, (raw - h["digital_low"][i]) * gain + h["low"][i], None


class EdfReader(DataSourceReader):
    """Plans partitions from the listing and reads them."""

    def __init__(self, options: dict):
        self.path, self.seconds = options["path"], float(options.get("blockseconds", BLOCK_SECONDS))
        self.rows_of_errors = options.get("errors") == "rows"
        split = lambda name: {x for x in options[name].split("\n") if x} if name in options else None
        self.wanted = Wanted(split("subjects"), split("channels"), float(options.get("from", 0)), float(options.get("to", "inf")))

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name, value = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None, getattr(f, "value", None)
            if isinstance(f, EqualTo | In) and name in ("subject_id", "channel"):
                self.wanted.only("subjects" if name == "subject_id" else "channels", set(value) if isinstance(f, In) else {value})
                continue  # exact: Spark needn't look again
            if name == "start" and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                self.wanted.begin = max(self.wanted.begin, float(value))
            if name == "start" and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                self.wanted.end = min(self.wanted.end, float(value))
            if name == "block" and isinstance(f, EqualTo):
                self.wanted.begin, self.wanted.end = max(self.wanted.begin, value * self.seconds), min(self.wanted.end, (value + 1) * self.seconds)
            yield f  # a bound: Spark looks again

    def partitions(self) -> list[Part]:
        chosen = [(p, size) for p, size in listed(self.path) if self.wanted.subjects is None or subject_of(p) in self.wanted.subjects]
        out, small, used = [], [], 0
        for path, size in chosen:
            if size > PARTITION_BYTES:
                n = -(-size // PARTITION_BYTES)
                out += [Part([(path, k, n)]) for k in range(n)]
                continue
            if small and used + size > PARTITION_BYTES:
                out.append(Part(small))
                small, used = [], 0
            small, used = [*small, (path, 0, 1)], used + size
        return [*out, *([Part(small)] if small else [])] or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.string()]
        batch = lambda row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)
        for path, k, n in partition.files:
            try:
                for row in blocks(path, k, n, self.wanted, self.seconds):
                    yield batch(row)
            except (SourceError, OSError, ValueError) as problem:
                if not self.rows_of_errors:
                    raise SourceError(f"{path}: {problem}") from problem
                yield batch((subject_of(path), None, None, None, None, None, str(problem)))


class EdfSource(DataSource):
    """``spark.read.format("edf")``."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EdfReader:
        return EdfReader({k.lower(): v for k, v in self.options.items()})


def scan(spark, path: str, subjects: list[str] | None = None, channels: list[str] | None = None, begin: float | None = None, end: float | None = None, errors: bool = True):
    """The blocks of a folder's recordings, pruned by subjects, channels and seconds before they are read."""
    from ..session import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EdfSource)
    out = spark.read.format("edf").option("errors", "rows" if errors else "raise")
    for name, value in (("subjects", subjects and "\n".join(subjects)), ("channels", channels and "\n".join(channels)), ("from", begin), ("to", end)):
        out = out if value is None else out.option(name, str(value))
    return out.load(path)
