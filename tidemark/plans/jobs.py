"""The three jobs: extract records of a cohort, analyse groups, compare stages and channels."""

from __future__ import annotations

import argparse
import logging
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import settings
from ..functions.scalars import STAGE_GROUPS, in_band
from ..operators import fits, relational, sleep, spectra, statistics, validation
from ..session import remove, session, shared_folder
from ..sources import edf, sinks, tables
from ..sources.errors import EDFFileNotFoundError
from ..sources.recordings import Recordings, require_safe, safe_id
from ..sources.store import Store, read_rows

log = logging.getLogger("tidemark")
# fixed values: channels of the analysis, and the parameters that groups are compared by; the rate makes the groups
# and is no evidence about them
CHANNELS = ("F3", "F4", "C3", "C4", "O1", "O2")
PARAMETERS = ["power", "peak_freq_hz", "peak_period_s", "bandwidth_hz", "auc", "chromatogram_peak_area"]


def _existing(read) -> DataFrame | None:
    """A table that an earlier run may have written."""
    try:
        return read()
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem) and "UNABLE_TO_INFER" not in str(problem):
            raise
        return None


def done(records: DataFrame, stages: tuple[str, ...], key: str = "ID") -> DataFrame:
    """Subjects with sound records of every stage and no unsound one."""
    sound, unsound = sinks.checked_records(records.filter(F.col("stage").isin(*stages)))
    marks = sound.select("subject_id", "stage", F.lit(0).alias("bad")).unionByName(unsound.select("subject_id", "stage", F.lit(1).alias("bad")))
    whole = marks.groupBy("subject_id").agg(F.count_distinct("stage").alias("n"), F.sum("bad").alias("bad")).filter((F.col("n") == len(stages)) & (F.col("bad") == 0))
    return whole.select(F.col("subject_id").alias(key))


def validate(spark: SparkSession, output: str, records: str, stages: tuple[str, ...] = tuple(STAGE_GROUPS)) -> dict[str, int]:
    """How many subjects of an earlier run's output have complete and sound records; nothing is computed or written."""
    listed = read_rows(spark, output, "ID", fmt="csv").select("ID").distinct()
    stored = _existing(lambda: tables.read_records(spark, records))
    sound = 0 if stored is None else listed.join(done(stored, stages), "ID", "left_semi").count()
    total = listed.count()
    return {"subjects": total, "valid": sound, "invalid": total - sound}


def extract(spark: SparkSession, metadata: list[str], edf_dir: str, hypno_dir: str, output: str, errors: str, records: str, subject: str | None = None, limit: int | None = None, shards: tuple[int, int] = (0, 1), overwrite: bool = False, dry_run: bool = False, aliases=None, stages: tuple[str, ...] = tuple(STAGE_GROUPS), recordings: Recordings | None = None, counters: dict[str, int] | None = None) -> DataFrame:
    """Metadata, sleep statistics and event records of all subjects that have both files and no sound records yet.

    Recordings are opened once and only those of the subjects to do; all failures are rows of the issues, those of a
    subject, of a channel and of a record that breaks its rules. A subject is done when each of ``stages`` has sound
    records; otherwise (or with ``overwrite``) it is done again, and its rows in records, metadata and issues are
    replaced, nobody else's. All three are stores (``sources.store``): shards may run at once, and a run that breaks off leaves
    what was there. ``recordings`` says how files are read, so readers may be put in; ``counters`` gets what was
    counted as it was written. Returns the tasks.
    """
    if stages_unknown := [s for s in stages if s not in STAGE_GROUPS]:
        raise ValueError(f"unknown stages: {', '.join(stages_unknown)}")
    recordings = recordings or Recordings(aliases=aliases, requested=None if aliases else list(CHANNELS), rate=K.SAMPLE_RATE)
    subjects = relational.coalesce_union([tables.read_metadata(spark, p) for p in metadata], "ID").filter(safe_id("ID"))
    if subject is not None:  # who is asked for by name must be there
        require_safe(spark.createDataFrame([(subject,)], "ID string"))
        mine = subjects.filter(F.col("ID") == subject)
        tables.require_files(tables.file_names(spark, edf_dir), mine, ".edf", error=EDFFileNotFoundError)
        tables.require_files(tables.file_names(spark, hypno_dir), mine, "_Hypnodensity.csv")
    subjects = relational.with_files(subjects, [(tables.file_names(spark, edf_dir), ".edf"), (tables.file_names(spark, hypno_dir), "_Hypnodensity.csv")])
    if subject is not None:
        subjects = subjects.filter(F.col("ID") == subject)
    elif limit is not None:
        subjects = subjects.orderBy("ID").limit(limit)
    if shards[1] > 1:
        subjects = relational.shard(subjects, "ID", *shards)
    stored = _existing(lambda: tables.read_records(spark, records))
    if stored is not None and not Store(spark, records, "subject_id", "stage").commits():  # a plain folder becomes a store
        Store(spark, records, "subject_id", "stage").write(stored, whole=True)
        stored = tables.read_records(spark, records)
    if overwrite:
        stored = None
    if stored is not None:
        subjects = relational.pending(subjects, done(stored, stages))
    if dry_run:
        return subjects
    folder = f"{shared_folder(spark)}/extract-{uuid.uuid4().hex}"
    subjects = subjects.checkpoint()  # what is to do was found in the records, which change below
    mine = subjects.select(F.col("ID").alias("subject_id"))
    # each of these subjects' files is opened once
    tables.hypnogram(tables.read_hypnodensity(spark, hypno_dir, subjects=subjects)).drop("probabilities").write.parquet(f"{folder}/epochs")
    epochs = spark.read.schema("subject_id string, epoch_idx int, ts timestamp, stage string, problem string, code int").parquet(f"{folder}/epochs")
    bad = epochs.filter("code is null").groupBy("subject_id").agg(F.min("problem").alias("error_message"))
    night = epochs.groupBy("subject_id").agg(F.count_if(F.col("code").isNull()).alias("bad"))
    epochs = epochs.join(bad, "subject_id", "left_anti")
    # the contents stay where they are read if the nights can be sent to them
    files = sleep.with_codes(edf.files(spark, edf_dir, subjects), epochs)
    sleep.stage_records(recordings.load(files), None, stages=stages).write.parquet(f"{folder}/records")
    found = spark.read.schema(sleep.RECORD).parquet(f"{folder}/records")
    new, unsound = sinks.checked_records(found.filter("error_type is null").drop("error_type", "error_message"))
    issue = lambda df, kind, text, state="", channel="": df.select("subject_id", *(F.lit(x).alias(n) if isinstance(x, str) else x.alias(n) for n, x in (("state", state), ("channel", channel), ("error_type", kind), ("error_message", text))))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    issues = issue(found.filter("error_type is not null"), F.col("error_type"), F.col("error_message"), blank("stage"), blank("channel"))
    issues = issues.unionByName(issue(unsound, "ValueError", F.array_join("problems", "; "), F.col("stage"), F.col("channel")))
    issues = issues.unionByName(issue(bad, "AnnotationLoadError", F.col("error_message")))
    issues = issues.unionByName(issue(mine.join(night, "subject_id", "left_anti"), "AnnotationLoadError", "no epochs"))
    # whoever reads the store of records sees a subject as done, so these are the last to be committed
    told = Store(spark, errors, "subject_id", fmt="csv", buckets=1).write(issues, mine, figures={"of_subjects": F.count_if(F.col("channel") == "")})
    rows = sinks.merged(None, sleep.metadata_rows(subjects, epochs), [*tables.METADATA, *sleep.STATISTICS])
    listed = Store(spark, output, "ID", fmt="csv", buckets=1).write(rows, subjects.select("ID"))
    scopes = mine.withColumn("stage", F.explode(F.lit(list(stages))))
    kept, _ = sinks.write_records(new, records, scopes, {"spectra": F.count_if(F.size("freqs") > 0), "events": F.sum(F.size("spindle_peak"))})
    if counters is not None:
        counters |= {"subjects": listed.rows, "issues": told.rows, "issues_of_subjects": told.figures["of_subjects"], "records": kept.rows, "spectra": kept.figures["spectra"], "events": kept.figures["events"]}
    remove(spark, folder)
    return subjects


def rates(unit: str = "min") -> tuple[Column, Column]:
    """A record's events per minute (or hour) of bout, and the standard error of its bouts' own rates."""
    factor = validation.rate_columns(unit)[2]
    length = F.zip_with("bout_start", "bout_stop", lambda a, b: (b - a) / 60)
    per = F.zip_with("bout_n_spindles", length, lambda n, m: n / m)
    size, total = F.size("bout_start"), F.aggregate(length, F.lit(0.0), lambda a, x: a + x)
    mean = F.aggregate(per, F.lit(0.0), lambda a, x: a + x) / size
    var = F.aggregate(per, F.lit(0.0), lambda a, x: a + F.pow(x - mean, 2)) / (size - 1)
    rate = F.when(total > 0, F.aggregate("bout_n_spindles", F.lit(0).cast("long"), lambda a, n: a + n) / total * factor)
    return rate, F.when(size > 1, F.sqrt(var) / F.sqrt(size) * factor).when(size == 1, 0.0)


def summaries(records: DataFrame, stage: str | None, channel: str | None, unit: str = "min", channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """One summary of each subject's record: fit, area, rate and why it is excluded.

    A subject that has records of the stage but none of the channel has a summary without values, whose reason says so.
    Without a stage and a channel all stages and all ``channels`` are summarised, a row for each subject, stage and channel.
    """
    rate, error, _ = validation.rate_columns(unit)
    keys = ["subject_id", "sleep_stage", "channel"]
    staged = records.withColumnRenamed("stage", "sleep_stage")
    staged = staged if stage is None else staged.filter(F.col("sleep_stage") == stage)
    everyone = staged.select("subject_id", "sleep_stage").distinct().withColumn("channel", F.explode(F.lit(list(channels) if channel is None else [channel])))
    own = staged.filter(F.col("channel").isin(list(channels) if channel is None else [channel]))
    counted = own.select(*keys, "freqs", "corr_mean", *(c.alias(n) for c, n in zip(rates(unit), (rate, error), strict=True)), F.lit(True).alias("_there"))
    counted = everyone.join(counted, keys, "left")
    counted = counted.withColumn("load_problem", F.when(F.col("_there").isNull(), F.concat(F.lit("missing channel "), "channel")).otherwise(validation.spectrum_problem())).drop("_there")
    peak = F.element_at("freqs", F.array_position("corr_mean", F.array_max("corr_mean")).cast("int"))
    counted = counted.withColumn("dominant_freq_hz", F.when(F.col("load_problem").isNull(), peak))
    fitted = fits.fit_curves(counted.filter("load_problem is null"), keys).withColumnRenamed("bandwidth", "bandwidth_hz")
    joined = counted.join(fitted, keys, "left")
    return joined.withColumn("exclusion_reason", F.coalesce("load_problem", "fit_error")).withColumn("power", F.col("amp")).drop("load_problem", "fit_error")


def summaries_of_files(spark: SparkSession, summary: str, records: str | None, stage: str, channel: str, unit: str = "min", subject: str = "subject_id") -> DataFrame:
    """Summaries that were computed before, with the spectra of stored records if these are named."""
    rate, error, _ = validation.rate_columns(unit)
    out = tables.read_summary(spark, summary, ["sleep_stage", "channel", *validation.REQUIRED, rate, error], subject)
    if records is not None:
        out = tables.attach_spectra(out, tables.read_records(spark, records, stage, channel))
        peak = F.element_at("freqs", F.array_position("corr_mean", F.array_max("corr_mean")).cast("int"))
        return out.withColumn("dominant_freq_hz", peak)
    nothing = F.lit(None).cast("array<double>")
    return out.withColumns({"freqs": nothing, "corr_mean": nothing, "dominant_freq_hz": F.lit(None).cast("double")})


def group_curves(subjects: DataFrame, keys: list[str], rate: str, within: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The mean curve of each group with errors and confidence band; and its peak's fit, subjects, mean rate and error."""
    named = subjects.withColumn("_all", F.lit("all_subjects"))
    own = keys or ["_all"]
    # one grid for all groups (of one analysis), that of the first subject, so that their curves can be compared
    same = spectra.same_grid(named.filter(F.size("freqs") > 0), within or ["_all"], "subject_id")
    long = same.select(*own, F.posexplode(F.arrays_zip("freqs", "corr_mean")).alias("k", "v")).select(*own, "k", F.col("v.freqs").alias("freq"), F.col("v.corr_mean").alias("value"))
    curve = spectra.mean_curves(long, own, "value", ["k", "freq"])
    lower, upper = statistics.normal_band(F.col("mean"), F.col("sem"), F.col("n"))
    curve = curve.withColumn("lower", lower).withColumn("upper", upper)
    arrays = curve.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("k", "freq", "mean"))).alias("c"), F.max("n").alias("n"))
    arrays = arrays.select(*own, "n", F.transform("c", lambda x: x["freq"]).alias("freqs"), F.transform("c", lambda x: x["mean"]).alias("corr_mean"))
    rates = named.groupBy(*own).agg(F.avg(rate).alias("rate"), F.coalesce(statistics.sem(rate), F.lit(0.0)).alias("rate_sem"))
    fitted = fits.fit_curves(arrays, [*own, "n"]).join(rates, own)
    return (curve, fitted) if keys else (curve.drop("_all"), fitted.drop("_all"))


def group_analysis(spark: SparkSession, summary: DataFrame, stage: str, channel: str, unit: str = "min", dominant_hz: float | None = None, alpha: float = 0.05, k: float = 0.0) -> dict[str, DataFrame]:
    """All tables of a group analysis, by name; ``dominant_hz`` takes the subjects whose largest value lies there."""
    rate, _, _ = validation.rate_columns(unit)
    spectra_there = "freqs" in summary.columns
    if dominant_hz is not None:
        summary = summary.filter(F.abs(F.col("dominant_freq_hz") - dominant_hz) <= validation.TOLERANCE)
    marked = validation.reasons(summary, stage, channel, unit, spectra=spectra_there)
    validated, excluded, report = validation.split(marked)
    groups = statistics.rate_groups(validated, rate, k)
    compared = statistics.compare(groups, "group", PARAMETERS, alpha=alpha).withColumn("sleep_stage", F.lit(stage)).withColumn("channel", F.lit(channel))
    out = {"validated": validated, "excluded": excluded, "validation_report": report, "validation_totals": validation.totals(marked, stage, channel, unit), "assignments": groups.select("subject_id", rate, "log_rate", "mean", "sd", "low", "high", "group"), "comparison": compared}
    scales = [statistics.histogram(groups, c).withColumn("scale", F.lit(s)) for c, s in ((rate, "raw"), ("log_rate", "log1p"))]
    out["pretransform"] = scales[0].unionByName(scales[1]).join(statistics.normal_fit(groups, rate).withColumnsRenamed({"mean": "fit_mean", "sd": "fit_sd"}).drop("n"), "scale")
    limits = groups.agg(F.expm1(F.max("low")).alias("low_threshold"), F.expm1(F.max("high")).alias("high_threshold"))
    out["distribution"] = statistics.histogram(groups, rate, group=["group"]).crossJoin(F.broadcast(limits))  # one row
    values = statistics.parameter_values(groups.select("subject_id", "group", *(F.col(p).cast("double").alias(p) for p in PARAMETERS)), ["subject_id", "group"], PARAMETERS)
    out["parameters_before"] = values.drop("group")
    out["parameters"] = values.filter(F.col("group").isin("low", "high")).join(compared.select("parameter", "q"), "parameter", "left")
    if spectra_there:
        out["bands"], out["curves"] = group_curves(groups, ["group"], rate)
        out["bands_before"], out["curves_before"] = group_curves(groups, [], rate)
    return out


def group_analyses(summary: DataFrame, unit: str = "min", alpha: float = 0.05, k: float = 0.0) -> dict[str, DataFrame]:
    """The tables of the group analyses of all stages, channels and dominant frequencies in one plan, by name.

    Each table has the columns sleep_stage, channel and dominant ("all", or the frequency in Hz); a subject stands in
    the analysis of all and in that of its own frequency. An analysis with fewer than two rates has only its exclusions.
    """
    rate, _, _ = validation.rate_columns(unit)
    keys = ["sleep_stage", "channel", "dominant"]
    slow = in_band("dominant_freq_hz", *K.SLOW_BAND)
    fanned = summary.withColumn("dominant", F.explode(F.array_compact(F.array(F.lit("all"), F.when(slow, F.format_number(F.round("dominant_freq_hz", 2), 2))))))
    marked = validation.reasons(fanned, None, None, unit, spectra="freqs" in summary.columns, by=keys)
    bad = F.col("exclusion_reason").isNotNull()
    out = {"validated": marked.filter(~bad).drop("exclusion_reason"), "excluded": marked.filter(bad)}
    out["validation_report"] = marked.groupBy(*keys, "exclusion_reason").agg(F.count("*").alias("count"))
    groups = statistics.rate_groups(out["validated"], rate, k, keys, few="drop")
    out["assignments"] = groups.select(*keys, "subject_id", rate, "log_rate", "mean", "sd", "low", "high", "group")
    out["comparison"] = statistics.compare(groups, "group", PARAMETERS, alpha=alpha, by=keys)
    out["distribution"] = statistics.histogram(groups, rate, group=[*keys, "group"])
    out["pretransform"] = statistics.histogram(groups, rate, group=keys).join(statistics.normal_fit(groups, rate, keys).filter("scale = 'raw'").withColumnsRenamed({"mean": "fit_mean", "sd": "fit_sd"}).drop("n"), keys)
    if "freqs" in summary.columns:
        out["bands"], out["curves"] = group_curves(groups, [*keys, "group"], rate, keys)
        out["bands_before"], out["curves_before"] = group_curves(groups, keys, rate, keys)
    return out


def write_group_analyses(out: dict[str, DataFrame], folder: str, overwrite: bool = False) -> None:
    """Each table as Parquet, a folder for each stage, channel and dominant frequency; refuses to replace any unless told to."""
    for name, df in out.items():
        df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("sleep_stage", "channel", "dominant").parquet(f"{folder}/{name}")


def write_group_analysis(spark: SparkSession, out: dict[str, DataFrame], folder: str, stage: str, channel: str, unit: str = "min", overwrite: bool = False) -> None:
    """All tables as Parquet and both reports as text; refuses to replace any unless told to."""
    mode = "overwrite" if overwrite else "errorifexists"
    names = sinks.output_names(stage, channel)
    for part, df in out.items():
        if part == "validation_report":
            sinks.write_text(spark, sinks.validation_text(df, stage, channel, out["validation_totals"]), f"{folder}/{names[part]}", overwrite)
        elif part in names:
            df.write.mode(mode).parquet(f"{folder}/{names[part]}")
    sinks.write_text(spark, sinks.grouping_text(out["assignments"], stage, channel, unit), f"{folder}/{names['grouping_report']}", overwrite)


def compare(records: DataFrame, unit: str = "min") -> DataFrame:
    """Per stage and channel: subjects, their mean rate with its error, the mean curve's peak fit, and the channel with the largest amplitude in its stage."""
    sound = records.filter((F.size("freqs") > 0) & validation.spectrum_problem().isNull())
    same = spectra.same_grid(sound, ["stage", "channel"], "subject_id")
    long = same.select("stage", "channel", "subject_id", F.posexplode(F.arrays_zip("freqs", "corr_mean")).alias("k", "v")).select("stage", "channel", "subject_id", "k", F.col("v.freqs").alias("freq"), F.col("v.corr_mean").alias("value"))
    curve = spectra.mean_curves(long, ["stage", "channel"], "value", ["k", "freq"])
    arrays = curve.groupBy("stage", "channel").agg(F.array_sort(F.collect_list(F.struct("freq", "mean", "sem"))).alias("c"), F.max("n").alias("subjects"))
    arrays = arrays.select("stage", "channel", "subjects", F.transform("c", lambda x: x["freq"]).alias("freqs"), F.transform("c", lambda x: x["mean"]).alias("corr_mean"))
    of_subjects = sound.withColumn("_rate", rates(unit)[0]).groupBy("stage", "channel").agg(F.avg("_rate").alias("rate"), F.coalesce(statistics.sem("_rate"), F.lit(0.0)).alias("rate_sem"))
    fitted = fits.fit_curves(arrays, ["stage", "channel", "subjects"]).join(of_subjects, ["stage", "channel"])
    best = fitted.groupBy("stage").agg(F.max_by("channel", F.struct("amp", "channel")).alias("best_channel"))
    return fitted.join(best, "stage").orderBy("stage", "channel")


def stage_curves(records: DataFrame, stages: tuple[str, ...], band: tuple[float, float] = K.SLOW_BAND, channel: str | None = None) -> DataFrame:
    """(subject_id, stage, freqs, corr_mean) of all sound spectra of the stages, cut to a band; subjects differ from stage to stage."""
    own = records.filter(F.col("stage").isin(*stages) & validation.spectrum_problem().isNull())
    own = own if channel is None else own.filter(F.col("channel") == channel)
    return spectra.crop(own.select("subject_id", "stage", "freqs", "corr_mean"), *band)


def dominant_groups(summary: DataFrame, peak: str = "peak_freq_hz") -> DataFrame:
    """Subjects by dominant frequency and in all, as one grouping set."""
    return summary.filter(in_band(peak, *K.SLOW_BAND)).rollup(F.round(peak, 2).alias("dominant_hz")).agg(F.count("*").alias("subjects"))


def arguments() -> argparse.ArgumentParser:
    """The command line; variables of the environment give defaults where a job array or a shell sets them."""
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--log-level", default="INFO", choices=("DEBUG", "INFO", "WARNING", "ERROR"))
    sub = p.add_subparsers(dest="job", required=True)
    e = sub.add_parser("extract")
    for name in ("--edf-dir", "--hypno-dir", "--output", "--error-output", "--records"):
        e.add_argument(name, required=True)
    e.add_argument("--metadata", action="append", required=True)
    e.add_argument("--subject-id")
    e.add_argument("--stages", nargs="+", choices=list(STAGE_GROUPS), default=list(STAGE_GROUPS))
    e.add_argument("--limit", type=int)
    e.add_argument("--num-shards", type=int, default=settings.count("SLURM_ARRAY_TASK_COUNT", 1, 1))
    e.add_argument("--shard-index", type=int, default=settings.count("SLURM_ARRAY_TASK_ID", 0))
    for name in ("--overwrite", "--dry-run", "--validate-only", "--strict"):
        e.add_argument(name, action="store_true")
    g = sub.add_parser("group")
    g.add_argument("--records")
    g.add_argument("--summary-results")
    g.add_argument("--spectrum-results")
    g.add_argument("--output-dir", required=True)
    g.add_argument("--sleep-stage", default="N2")
    g.add_argument("--channel", default="C3")
    g.add_argument("--subject-id-column", default="subject_id")
    g.add_argument("--rate-unit", choices=("min", "hr"), default="min")
    g.add_argument("--dominant-freq-hz", type=float)
    g.add_argument("--fdr-alpha", type=float, default=0.05)
    g.add_argument("--n-subjects", type=int)
    g.add_argument("--every", action="store_true", help="all stages, channels and dominant frequencies of --records in one run")
    g.add_argument("--overwrite", action="store_true")
    c = sub.add_parser("compare")
    c.add_argument("--records", required=True)
    c.add_argument("--output-dir", required=True)
    c.add_argument("--n-subjects", type=int, default=settings.whole("N_SUBJECTS"))
    c.add_argument("--show-individual", action=argparse.BooleanOptionalAction, default=settings.flag("SHOW_INDIVIDUAL"))
    return p


def main(argv: list[str] | None = None) -> None:
    """Command line of the three jobs."""
    p = arguments()
    a = p.parse_args(argv)
    logging.basicConfig(level=a.log_level, format="%(asctime)s [%(levelname)s] %(message)s", datefmt="%Y-%m-%d %H:%M:%S")
    at = lambda path: None if path is None else settings.expand(path)
    if a.job == "extract" and not 0 <= a.shard_index < a.num_shards:
        p.error(f"shard {a.shard_index} of {a.num_shards} doesn't exist")
    if a.job == "group" and a.records is None and a.summary_results is None:
        p.error("one of --records and --summary-results is needed")
    spark = session()
    if a.job == "extract":
        stages = tuple(s for s in STAGE_GROUPS if s in a.stages)
        if a.validate_only:
            print(" ".join(f"{k}: {n}" for k, n in validate(spark, at(a.output), at(a.records), stages).items()))
            return
        how = Recordings(requested=list(CHANNELS), rate=K.SAMPLE_RATE, strict=a.strict)
        counters: dict[str, int] = {}
        tasks = extract(spark, [at(m) for m in a.metadata], at(a.edf_dir), at(a.hypno_dir), at(a.output), at(a.error_output), at(a.records), a.subject_id, a.limit, (a.shard_index, a.num_shards), a.overwrite, a.dry_run, stages=stages, recordings=how, counters=counters)
        if a.dry_run:
            print(f"{tasks.count()} subjects to do")
        else:
            print(" ".join(f"{k}: {n}" for k, n in counters.items()))
    elif a.job == "group" and a.every:
        if a.records is None:
            p.error("--every needs --records")
        summary = summaries(tables.read_records(spark, at(a.records), limit=a.n_subjects), None, None, a.rate_unit)
        write_group_analyses(group_analyses(summary, a.rate_unit, a.fdr_alpha), at(a.output_dir), a.overwrite)
    elif a.job == "group":
        if a.summary_results is not None:
            summary = summaries_of_files(spark, at(a.summary_results), at(a.spectrum_results), a.sleep_stage, a.channel, a.rate_unit, a.subject_id_column)
        else:
            summary = summaries(tables.read_records(spark, at(a.records), a.sleep_stage, limit=a.n_subjects), a.sleep_stage, a.channel, a.rate_unit)
        out = group_analysis(spark, summary, a.sleep_stage, a.channel, a.rate_unit, a.dominant_freq_hz, a.fdr_alpha)
        write_group_analysis(spark, out, at(a.output_dir), a.sleep_stage, a.channel, a.rate_unit, a.overwrite)
    else:
        records = tables.read_records(spark, at(a.records), limit=a.n_subjects)
        sinks.write_csv(compare(records).drop("fitted_freqs", "fitted_curve"), f"{at(a.output_dir)}/summary")
        if a.show_individual:
            own = records.select("stage", "channel", "subject_id", F.posexplode(F.arrays_zip("freqs", "corr_mean")).alias("k", "v"))
            own.select("stage", "channel", "subject_id", F.col("v.freqs").alias("freq"), F.col("v.corr_mean").alias("value")).write.parquet(f"{at(a.output_dir)}/individual")


if __name__ == "__main__":
    main()
