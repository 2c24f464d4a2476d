"""The jobs end to end on synthetic subjects, and increments of a stream."""

import numpy as np
import pytest

from tidemark.plans import jobs
from tidemark.sources import edf, errors, tables
from tidemark.sources.store import Store, read_rows
from tidemark.streaming import incremental


def night(seed: int, bout: bool) -> tuple[np.ndarray, list[str]]:
    r = np.random.default_rng(seed)
    n = 14 if bout else 6
    x = r.normal(0, 5, 128 * 30 * 16)
    for k in range(12, n * 30 - 5, 12):
        x[128 * k : 128 * (k + 1)] += 40 * np.sin(2 * np.pi * 13 * np.arange(128) / 128) * np.hanning(128)
    return x, ["N2"] * n + ["Wake"] * (16 - n)


@pytest.fixture(scope="module")
def cohort(tmp_path_factory):
    root = tmp_path_factory.mktemp("cohort")
    (root / "edf").mkdir()
    (root / "hypno").mkdir()
    names = ("Wake", "N1", "N2", "N3", "REM")
    lines = ["ID,Age,Gender,BMI"]
    for k, (sid, bout) in enumerate((("all", True), ("few", True), ("nobout", False), ("more", True))):
        x, stages = night(k, bout)
        labels = ["C3M2", "C4M1", "O1M2"] if sid != "few" else ["C3M2"]
        (root / "edf" / f"{sid}.edf").write_bytes(edf.write_edf([(c, 128, x + i) for i, c in enumerate(labels)]))
        rows = [",".join(["2024-01-01 00:00:00", *("1" if s == n else "0" for n in names)]) for s in stages]
        (root / "hypno" / f"{sid}_Hypnodensity.csv").write_text("\n".join(["Timestamp," + ",".join(names), *rows]) + "\n")
        lines.append(f"{sid},{40 + k},F,25")
    (root / "meta.csv").write_text("\n".join([*lines, "ghost,1,M,20"]) + "\n")
    return root


def test_extract_group_and_compare(spark, cohort):
    p = {k: str(cohort / k) for k in ("out", "err", "records")}
    run = lambda **more: jobs.extract(spark, [str(cohort / "meta.csv")], str(cohort / "edf"), str(cohort / "hypno"), p["out"], p["err"], p["records"], **more)
    assert sorted(r.ID for r in run(dry_run=True).collect()) == ["all", "few", "more", "nobout"]
    run()
    records = tables.read_records(spark, p["records"])
    n2 = {(r.subject_id, r.channel): r for r in records.filter("stage = 'N2'").collect()}
    assert set(n2) >= {("all", "C3"), ("all", "C4"), ("few", "C3"), ("more", "C3")}
    assert n2[("all", "C3")].bout_n_spindles[0] > 20 and len(n2[("all", "C3")].freqs) == 51 and len(n2[("nobout", "C3")].bout_start) == 0
    assert len(read_rows(spark, p["out"], "ID", fmt="csv").columns) == 25
    assert run(dry_run=True).count() == 0  # nothing is left to do
    summary = jobs.summaries(records, "N2", "C3")
    tables_ = jobs.group_analysis(spark, summary, "N2", "C3")
    reasons = {r.subject_id: r.exclusion_reason for r in tables_["excluded"].collect()}
    assert reasons == {"nobout": "spectrum empty"}
    assert {r["group"] for r in tables_["assignments"].collect()} <= {"low", "mid", "high"}
    assert [r.parameter for r in tables_["comparison"].collect()] == ["power", "peak_freq_hz", "peak_period_s", "bandwidth_hz", "auc", "chromatogram_peak_area"]
    assert tables_["bands_before"].count() == 51 and tables_["curves_before"].first().n == 3
    curve = {r.freq: (r["mean"], r["sem"]) for r in tables_["bands_before"].collect()}
    own = [r for r in records.filter("stage = 'N2' AND channel = 'C3' AND size(freqs) > 0").collect()]
    for k, f in enumerate(own[0].freqs):
        v = np.array([r.corr_mean[k] for r in own])
        assert curve[f] == pytest.approx((v.mean(), v.std(ddof=1) / 3**0.5))
    rates = [r.spindle_per_min for r in tables_["validated"].collect()]
    whole = tables_["curves_before"].first()
    assert (whole.rate, whole.rate_sem) == pytest.approx((np.mean(rates), np.std(rates, ddof=1) / 3**0.5)) and whole.fit_error is None
    assert {r.n for r in tables_["curves"].collect()} <= {1, 2} and tables_["parameters_before"].count() == 18
    assert tables_["validation_totals"].first().asDict() | {"total": 4, "valid": 3, "excluded": 1, "valid_spectrum": 3} == tables_["validation_totals"].first().asDict()
    folder = f"{cohort}/group"
    jobs.write_group_analysis(spark, tables_, folder, "N2", "C3")
    assert "valid spectrum: 3" in "\n".join(r.value for r in spark.read.text(f"{folder}/validation_report_N2_C3").collect())
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        jobs.write_group_analysis(spark, tables_, folder, "N2", "C3")
    # the same from a summary that was written before, with the spectra of the records
    columns = ["subject_id", "sleep_stage", "channel", "peak_freq_hz", "peak_period_s", "bandwidth_hz", "auc", "chromatogram_peak_area", "power", "spindle_per_min", "spindle_per_min_SEM"]
    summary.select(*columns).withColumnRenamed("subject_id", "who").write.option("header", True).csv(f"{cohort}/summary")
    again = jobs.group_analysis(spark, jobs.summaries_of_files(spark, f"{cohort}/summary", p["records"], "N2", "C3", subject="who"), "N2", "C3")
    assert sorted((r.subject_id, r["group"]) for r in again["assignments"].collect()) == sorted((r.subject_id, r["group"]) for r in tables_["assignments"].collect())
    peak = summary.filter("subject_id = 'all'").first().dominant_freq_hz
    assert "all" in {r.subject_id for r in validated_at(spark, summary, peak)}
    both = jobs.compare(records).collect()
    assert {(r.stage, r.channel, r.subjects) for r in both} >= {("N2", "C3", 3), ("N2", "C4", 2)}
    one = next(r for r in both if (r.stage, r.channel) == ("N2", "C3"))
    assert (one.rate, one.rate_sem) == pytest.approx((np.mean(rates), np.std(rates, ddof=1) / 3**0.5))
    # a subject without the channel is excluded for that
    reasons = {r.subject_id: r.exclusion_reason for r in jobs.summaries(records, "N2", "C4").collect()}
    assert reasons["few"] == "missing channel C4" and reasons["all"] is None
    every = jobs.group_analyses(jobs.summaries(records, None, None))
    own = every["assignments"].filter("sleep_stage = 'N2' AND channel = 'C3' AND dominant = 'all'")
    assert sorted((r.subject_id, r["group"]) for r in own.collect()) == sorted((r.subject_id, r["group"]) for r in tables_["assignments"].collect())
    same = lambda df: {r.parameter: (r.test, r.p, r.q, r.effect) for r in df.collect()}
    assert same(every["comparison"].filter("sleep_stage = 'N2' AND channel = 'C3' AND dominant = 'all'")) == same(tables_["comparison"])
    bands = {r.freq: r["mean"] for r in every["bands_before"].filter("sleep_stage = 'N2' AND channel = 'C3' AND dominant = 'all'").collect()}
    assert bands == pytest.approx({f: m for f, (m, _) in curve.items()})
    excluded = {(r.subject_id, r.exclusion_reason) for r in every["excluded"].filter("sleep_stage = 'N2' AND channel = 'O2' AND dominant = 'all'").collect()}
    assert ("all", "missing channel O2") in excluded and {r.dominant for r in every["validated"].collect()} > {"all"}
    jobs.write_group_analyses(every, f"{cohort}/every")
    assert spark.read.parquet(f"{cohort}/every/comparison").select("sleep_stage", "channel", "dominant").distinct().count() >= 2


def validated_at(spark, summary, peak):
    from pyspark.sql import functions as F

    return summary.filter(F.abs(F.col("dominant_freq_hz") - peak) <= 1e-6).collect()


def test_only_what_lacks_is_done_again_and_problems_are_issues(spark, cohort):
    """A corrupted record is rebuilt, and what fails is told once."""
    import shutil

    root = cohort / "again"
    shutil.copytree(cohort / "edf", root / "edf")
    shutil.copytree(cohort / "hypno", root / "hypno")
    (root / "edf" / "broken.edf").write_bytes(b"nothing")
    (root / "hypno" / "broken_Hypnodensity.csv").write_text((root / "hypno" / "all_Hypnodensity.csv").read_text())
    (root / "edf" / "odd.edf").write_bytes((root / "edf" / "all.edf").read_bytes())
    (root / "hypno" / "odd_Hypnodensity.csv").write_text("Time,N2\n0,1\n")
    (root / "meta.csv").write_text((cohort / "meta.csv").read_text() + "\nbroken,1,M,20\nodd,1,M,20\n../up,1,M,20\n")
    p = {k: str(root / k) for k in ("out", "err", "records")}
    run = lambda **more: jobs.extract(spark, [str(root / "meta.csv")], str(root / "edf"), str(root / "hypno"), p["out"], p["err"], p["records"], **more)
    run()
    issues = lambda: sorted((r.subject_id, r.error_type) for r in read_rows(spark, p["err"], "subject_id", fmt="csv").collect())
    assert issues() == [("broken", "DataLoadError"), ("odd", "AnnotationLoadError")]
    assert sorted(r.ID for r in run(dry_run=True).collect()) == ["broken", "odd"]
    assert jobs.validate(spark, p["out"], p["records"]) == {"subjects": 6, "valid": 4, "invalid": 2}
    # a record that breaks a rule: its subject is done again, its rows are replaced, nothing is there twice
    stored = tables.read_records(spark, p["records"]).checkpoint()
    from pyspark.sql import functions as F

    hurt = stored.withColumn("bout_n_spindles", F.when((F.col("subject_id") == "all") & (F.col("stage") == "N2") & (F.col("channel") == "C3"), F.array(F.lit(1).cast("long"))).otherwise(F.col("bout_n_spindles")))
    Store(spark, p["records"], "subject_id", "stage").write(hurt.filter("subject_id = 'all' AND stage = 'N2'"))
    assert sorted(r.ID for r in run(dry_run=True).collect()) == ["all", "broken", "odd"]
    run()
    spark.catalog.clearCache()
    key = lambda df: sorted((r.subject_id, r.stage, r.channel, len(r.spindle_peak), sum(r.bout_n_spindles)) for r in df.collect())
    assert key(tables.read_records(spark, p["records"])) == key(stored) and len(issues()) == 2
    rows = read_rows(spark, p["out"], "ID", fmt="csv").collect()
    assert sorted(r.ID for r in rows) == ["all", "broken", "few", "more", "nobout", "odd"]
    assert run(subject="few", overwrite=False, dry_run=True).count() == 0 and run(limit=1, stages=("N2",), dry_run=True).count() <= 1
    with pytest.raises(ValueError):
        run(stages=("N9",))
    # a subject asked for by name must have an id that names a file, and its files
    (root / "hypno" / "lost_Hypnodensity.csv").write_text("x")
    (root / "meta.csv").write_text((root / "meta.csv").read_text() + "lost,1,M,20\n")
    for name, error in (("lost", errors.EDFFileNotFoundError), ("../up", errors.InvalidSubjectIDError)):
        with pytest.raises(error):
            run(subject=name, dry_run=True)


def test_overwriting_one_subject_leaves_the_others(spark, cohort):
    """Ids with blanks and brackets from listing to records; shards and single subjects side by side."""
    import shutil

    root = cohort / "names"
    (root / "edf").mkdir(parents=True)
    (root / "hypno").mkdir()
    for source, name in (("all", "S 2"), ("more", "S[3]"), ("few", "a+b")):
        shutil.copy(cohort / "edf" / f"{source}.edf", root / "edf" / f"{name}.edf")
        shutil.copy(cohort / "hypno" / f"{source}_Hypnodensity.csv", root / "hypno" / f"{name}_Hypnodensity.csv")
    (root / "meta.csv").write_text("ID,Age,Gender,BMI\nS 2,1,M,20\nS[3],2,F,21\na+b,3,F,22\n")
    p = {k: str(root / k) for k in ("out", "err", "records")}
    counters: dict = {}
    run = lambda **more: jobs.extract(spark, [str(root / "meta.csv")], str(root / "edf"), str(root / "hypno"), p["out"], p["err"], p["records"], **more)
    run(subject="S 2", counters=counters)
    assert counters["subjects"] == 1 and counters["records"] > 0 and counters["issues"] == 0 and counters["spectra"] > 0
    run(shards=(0, 2))
    run(shards=(1, 2))
    rows = lambda: sorted((r.subject_id, r.stage, r.channel, len(r.spindle_peak)) for r in tables.read_records(spark, p["records"]).collect())
    before = rows()
    files = {f: f.stat().st_mtime_ns for f in (root / "records").rglob("part-*")}
    assert {r[0] for r in before} == {"S 2", "S[3]", "a+b"}
    run(subject="S[3]", overwrite=True)
    assert rows() == before and files.items() <= {f: f.stat().st_mtime_ns for f in (root / "records").rglob("part-*")}.items()
    assert sorted(r.ID for r in read_rows(spark, p["out"], "ID", fmt="csv").collect()) == ["S 2", "S[3]", "a+b"]


def test_command_line(monkeypatch):
    monkeypatch.setenv("SLURM_ARRAY_TASK_COUNT", "4")
    monkeypatch.setenv("SLURM_ARRAY_TASK_ID", "2")
    monkeypatch.setenv("SHOW_INDIVIDUAL", "yes")
    monkeypatch.setenv("N_SUBJECTS", "none")
    need = ["--metadata", "m", "--edf-dir", "e", "--hypno-dir", "h", "--output", "o", "--error-output", "x", "--records", "r"]
    a = jobs.arguments().parse_args(["extract", *need, "--stages", "N2", "--validate-only"])
    assert (a.num_shards, a.shard_index, a.stages, a.validate_only) == (4, 2, ["N2"], True)
    a = jobs.arguments().parse_args(["compare", "--records", "r", "--output-dir", "o"])
    assert a.show_individual and a.n_subjects is None
    with pytest.raises(SystemExit):
        jobs.main(["group", "--output-dir", "o"])


def test_a_second_call_adds_nothing(spark, tmp_path):
    df = spark.range(20).withColumnRenamed("id", "k")
    a = dict(schema=df.schema, target=f"{tmp_path}/out", checkpoint=f"{tmp_path}/state", key="k")
    df.filter("k < 12").write.parquet(f"{tmp_path}/in/0")
    incremental.ingest_new(spark, f"{tmp_path}/in/*", **a)
    incremental.ingest_new(spark, f"{tmp_path}/in/*", **a)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 12
    df.filter("k >= 8").write.parquet(f"{tmp_path}/in/1")
    incremental.ingest_new(spark, f"{tmp_path}/in/*", **a)
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(20))
