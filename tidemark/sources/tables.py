"""Metadata, hypnodensity and record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clean_id, finite, stage_code
from .errors import AnnotationLoadError, SourceError
from .store import read_rows

METADATA = ("ID", "Age", "Gender", "BMI")
#: Names of files that go into a scan's filter.
FILES = 50_000


def file_name() -> Column:
    """The name of the file that a row was read from; Spark gives it with its blanks, brackets and signs encoded, the plus aside."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """ID, Age, Gender, BMI from a CSV with a header; other columns aren't read, absent ones are null, blank ids go."""
    raw = spark.read.option("header", True).csv(path)  # all columns are text: no pass over the data to infer types
    if "ID" not in raw.columns:
        raise SourceError(f"no ID column in {path}")
    pick = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    gender = F.trim(pick("Gender"))
    out = raw.select(clean_id("ID").alias("ID"), pick("Age").try_cast("double").alias("Age"), F.when((gender != "") & (F.lower(gender) != "nan"), gender).alias("Gender"), pick("BMI").try_cast("double").alias("BMI"))
    return out.filter("ID is not null")


def of_subjects(files: DataFrame, path: str, suffix: str, subjects: DataFrame | None, key: str = "ID") -> DataFrame:
    """The files that are some subjects' (id + suffix), pruned by name before any is opened.

    The listing joins the subjects; up to FILES names go into the scan's own filter, and more are joined to what was
    read. ``files`` is what a reader loaded from ``path``.
    """
    if subjects is None:
        return files.filter(file_name().endswith(suffix))
    listed = files.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(file_name().alias("name"), F.col("_metadata.file_name").alias("raw"))
    wanted = subjects.select(F.concat(F.col(key), F.lit(suffix)).alias("name")).distinct()
    names = [r.raw for r in listed.join(wanted, "name", "left_semi").select("raw").limit(FILES + 1).collect()]
    if len(names) <= FILES:
        return files.filter(F.col("_metadata.file_name").isin(names))
    return files.withColumn("_name", file_name()).join(wanted, F.col("_name") == wanted["name"], "left_semi").drop("_name")


def read_hypnodensity(spark: SparkSession, path: str, suffix: str = "_Hypnodensity.csv", columns: tuple[str, ...] | None = None, timestamp: str = "Timestamp", relabel: dict[str, str] | None = None, strict: bool = False, subjects: DataFrame | None = None) -> DataFrame:
    """subject_id, epoch_idx, ts, probabilities (a map by column), stage and problem of all files below a path.

    An epoch's index is its line's place in its file; a file is read whole, as its lines have no other order. The
    subject is the file's name without the suffix. An epoch's stage is the column with the largest probability, the
    first of equal ones in the order of ``columns`` or else of the file's header; ``relabel`` renames stages. Bad
    probabilities are passed over; an epoch without any has a null stage. A file without the time column, without any
    other or without one of ``columns`` has a problem in every row, or raises if ``strict``. With ``subjects`` (ID) only
    their files are opened.
    """
    files = of_subjects(spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path), path, suffix, subjects)
    files = files.select(file_name().alias("_file"), F.col("value").alias("_text")).withColumn("_lines", F.split("_text", r"\r?\n"))
    files = files.withColumn("_header", F.transform(F.split(F.col("_lines")[0], ","), lambda c: F.trim(c)))
    names = F.array(*(F.lit(c) for c in columns)) if columns else F.filter("_header", lambda c: (c != timestamp) & (c != ""))
    lacking = F.array_except(names, F.col("_header"))
    problem = F.when(~F.array_contains("_header", timestamp), f"no column {timestamp}").when(F.size(names) == 0, "no columns of stages").when(F.size(lacking) > 0, F.concat(F.lit("no column "), F.array_join(lacking, ", ")))
    if strict:
        problem = F.when(problem.isNotNull(), F.raise_error(F.concat("_file", F.lit(": "), problem)))
    subject = F.regexp_replace("_file", f"{suffix.replace('.', '[.]')}$", "").alias("subject_id")
    lines = files.select(subject, "_header", names.alias("_names"), problem.alias("_problem"), F.posexplode(F.slice("_lines", 2, 1 << 30)).alias("epoch_idx", "_line"))
    cells = lines.filter(F.trim("_line") != "").withColumn("_cells", F.split("_line", ","))
    at = lambda name: F.try_element_at(F.col("_cells"), F.array_position("_header", name).cast("int"))
    ts = F.when(F.array_contains("_header", timestamp), F.try_to_timestamp(F.trim(F.try_element_at(F.col("_cells"), F.greatest(F.array_position("_header", F.lit(timestamp)).cast("int"), F.lit(1))))))
    values = F.transform("_names", lambda n: F.when(F.array_contains("_header", n), F.trim(at(n)).try_cast("double")))
    out = cells.select("subject_id", "epoch_idx", ts.alias("ts"), "_names", values.alias("_values"), F.col("_problem").cast("string").alias("problem"))
    usable = F.transform("_values", lambda v: F.when(finite(v), v))
    winner = F.when(F.array_max(usable).isNotNull(), F.element_at("_names", F.array_position(usable, F.array_max(usable)).cast("int")))
    if relabel:
        table = F.create_map(*(F.lit(x) for pair in relabel.items() for x in pair))
        winner = F.coalesce(F.try_element_at(table, winner), winner)
    return out.select("subject_id", "epoch_idx", "ts", F.map_from_arrays("_names", "_values").alias("probabilities"), F.when(F.col("problem").isNull(), winner).alias("stage"), "problem")


def hypnogram(annotations: DataFrame, codes: dict[str, int] | None = None, strict: bool = False) -> DataFrame:
    """Adds the stages' codes; with ``strict`` an unknown label raises, else it is null and ``problem`` says so."""
    out = annotations.withColumn("code", stage_code("stage", codes, strict))
    unknown = F.when(F.col("code").isNull(), F.concat(F.lit("unknown stage: "), F.coalesce("stage", F.lit("none"))))
    return out if strict else out.withColumn("problem", F.coalesce("problem", unknown) if "problem" in out.columns else unknown)


def require_files(listing: DataFrame, subjects: DataFrame, suffix: str, key: str = "ID", required: bool = True, error: type[SourceError] = AnnotationLoadError) -> DataFrame:
    """The subjects that have a file named key + suffix; with ``required`` one without raises."""
    named = listing.select(F.col("name").alias("_name")).distinct()
    mine = F.concat(F.col(key), F.lit(suffix))
    if required and (lost := subjects.join(named, mine == F.col("_name"), "left_anti").select(key).first()) is not None:
        raise error(f"no file {lost[0]}{suffix}")
    return subjects.join(named, mine == F.col("_name"), "left_semi")


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of the files below a path; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(file_name().alias("name"))


def read_records(spark: SparkSession, path: str, stage: str | None = None, channel: str | None = None, limit: int | None = None) -> DataFrame:
    """Event records that hold now; stage is a partition and channel a pushed predicate. ``limit`` takes the first subjects by id."""
    out = read_rows(spark, path, "subject_id", "stage")
    if stage is not None:
        out = out.filter(F.col("stage") == stage)
    if channel is not None:
        out = out.filter(F.col("channel") == channel)
    if limit is not None:
        out = out.join(out.select("subject_id").distinct().orderBy("subject_id").limit(limit), "subject_id", "left_semi")
    return out


def read_summary(spark: SparkSession, path: str, required: list[str], subject: str = "subject_id") -> DataFrame:
    """A summary CSV; required columns must be there, and all but ids, stage and channel are numbers; ``subject`` names the ids."""
    raw = spark.read.option("header", True).csv(path)
    if subject != "subject_id" and subject in raw.columns:
        raw = raw.withColumnRenamed(subject, "subject_id")
    if lacking := [c for c in ["subject_id", *required] if c not in raw.columns]:
        raise SourceError(f"summary lacks {', '.join(lacking)}")
    text = ("subject_id", "sleep_stage", "channel", "exclusion_reason")
    out = raw.select(*(F.col(c) if c in text else F.col(c).try_cast("double").alias(c) for c in raw.columns))
    return out if "power" in out.columns else out.withColumn("power", F.lit(None).cast("double"))


def attach_spectra(summary: DataFrame, records: DataFrame) -> DataFrame:
    """Summaries with their subject's spectrum, null where there is none."""
    spectra = records.filter(F.size("freqs") > 0).select("subject_id", "freqs", "corr_mean")
    return summary.join(spectra, "subject_id", "left")


SIGNALS = T.StructType([T.StructField("subject_id", T.StringType()), T.StructField("channel", T.StringType()), T.StructField("sf", T.DoubleType()), T.StructField("samples", T.ArrayType(T.DoubleType()))])
