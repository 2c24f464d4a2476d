"""Writers: records by stage, tables, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.validation import record_problems
from .store import Commit, Store

RESULTS = ["ID", "Age", "Gender", "BMI"]


def checked_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound records, and the others with their problems."""
    marked = records.withColumn("problems", F.when(F.size("freqs") + F.size("bout_start") == 0, F.array().cast("array<string>")).otherwise(record_problems()))
    return marked.filter(F.size("problems") == 0).drop("problems"), marked.filter(F.size("problems") > 0)


def write_records(records: DataFrame, path: str, replaced: DataFrame | None = None, figures: dict[str, Column] | None = None) -> tuple[Commit, DataFrame]:
    """Sound records into the store at a path, in place of those of ``replaced`` (subject_id, stage); and the others with their problems."""
    sound, unsound = checked_records(records)
    return Store(records.sparkSession, path, "subject_id", "stage").write(sound, replaced, figures=figures), unsound


def merged(prior: DataFrame | None, new: DataFrame, columns: list[str]) -> DataFrame:
    """Earlier and new rows in a fixed order of columns; absent ones are null."""
    both = new if prior is None else prior.unionByName(new, allowMissingColumns=True)
    return both.select(*(F.col(f"`{c}`") if c in both.columns else F.lit(None).cast("double").alias(c) for c in columns))


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A CSV folder with headers; refuses to replace one unless told to."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


# fixed values: what a group analysis writes, by the stems of its files; a figure's stem names the table behind it
OUTPUTS = {
    "validated": "validated_{0}_subject_results",
    "excluded": "invalid_or_excluded_{0}_subjects",
    "validation_report": "validation_report_{0}",
    "assignments": "{0}_subject_group_assignments",
    "grouping_report": "grouping_report_{0}",
    "comparison": "{0}_group_comparison",
    "pretransform": "{0}_spindle_rate_pretransform_distribution",
    "distribution": "{0}_spindle_rate_group_distribution",
    "parameters": "{0}_parameter_group_comparisons",
    "curves": "{0}_group_curves",
    "bands": "{0}_power_by_spindle_group",
    "parameters_before": "{0}_parameter_group_comparisons_before",
    "curves_before": "{0}_group_curves_before",
    "bands_before": "{0}_power_by_spindle_group_before",
}


def output_names(stage: str, channel: str) -> dict[str, str]:
    """Names of the outputs of a group analysis."""
    return {k: name.format(f"{stage}_{channel}") for k, name in OUTPUTS.items()}


def write_text(spark, text: str, path: str, overwrite: bool = False) -> None:
    """A report as one text file in a folder of its own; refuses to replace one unless told to."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def validation_text(report: DataFrame, stage: str, channel: str, totals: DataFrame | None = None) -> str:
    """A report of exclusions from the counts of reasons and, if given, the totals; both have few rows."""
    rows = report.collect()
    kept = sum(r["count"] for r in rows if r["exclusion_reason"] is None)
    lines = [f"validation of {stage} {channel}", f"kept: {kept}", f"excluded: {sum(r['count'] for r in rows) - kept}"]
    if totals is not None:
        lines += [f"{name.replace('_', ' ', 1)}: {value}" for name, value in totals.first().asDict().items()]
    return "\n".join([*lines, "reasons:", *(f"  {r['exclusion_reason']}: {r['count']}" for r in rows if r["exclusion_reason"] is not None)])


def grouping_text(groups: DataFrame, stage: str, channel: str, unit: str) -> str:
    """A report of the groups' sizes and thresholds in the rate's own scale."""
    r = groups.agg(F.max(F.expm1("low")).alias("low"), F.max(F.expm1("high")).alias("high"), *(F.count_if(F.col("group") == g).alias(f"n_{g}") for g in ("low", "mid", "high"))).first()
    return f"groups of {stage} {channel}\nlow below {r['low']:.4f} per {unit}: {r['n_low']}\nmid: {r['n_mid']}\nhigh above {r['high']:.4f} per {unit}: {r['n_high']}" if r["low"] is not None else f"groups of {stage} {channel}\nnone"
