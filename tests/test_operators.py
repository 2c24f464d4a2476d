"""Operators on small fixtures and against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import clean_id, first_max, is_nan, stage_code
from tidemark.operators import fits, intervals, relational, sleep, spectra, statistics, validation
from tidemark.sources import edf, recordings, sinks, tables

N1, N2, N3, W, ART = 1, 2, 3, 0, -1
HYPNOGRAMS = {"n2_7": ([N2] * 7, [(0, 210)], [(0, 210)]), "n2_6": ([N2] * 6, [], []), "mixed": ([N1] * 3 + [N2] * 3 + [N3] * 3, [], [(0, 270)]), "split": ([N2] * 7 + [W] + [N2] * 7, [(0, 210), (240, 450)], [(0, 210), (240, 450)]), "ends": ([W] + [N2] * 8, [(30, 270)], [(30, 270)]), "art": ([N2] * 4 + [ART] + [N2] * 4, [], [])}


def epochs(spark):
    return spark.createDataFrame([(k, i, c) for k, (codes, _, _) in HYPNOGRAMS.items() for i, c in enumerate(codes)], "subject_id string, epoch_idx int, code int")


def test_bouts_of_the_fixtures(spark):
    got = sleep.stage_bouts(epochs(spark)).collect()
    for k, (_, n2, nrem) in HYPNOGRAMS.items():
        of = lambda stage, k=k: sorted((r.start, r.stop) for r in got if r.subject_id == k and r.stage == stage)
        assert of("N2") == n2 and of("NREM") == nrem, k


def test_points_meet_intervals_as_in_a_nested_loop(spark):
    r = random.Random(5)
    iv = [(s, b * 10.0, b * 10.0 + r.choice([3.0, 10.0]), b) for s in "ab" for b in range(30)]
    pts = [(r.choice("abc"), i, r.choice([r.uniform(-5, 310), float(r.randrange(31) * 10), r.randrange(30) * 10.0 + 3])) for i in range(400)]
    i_df, p_df = spark.createDataFrame(iv, "s string, start double, stop double, idx int"), spark.createDataFrame(pts, "s string, id int, peak double")
    got = {(x.id, x.idx) for x in intervals.points_in_intervals(p_df, i_df, ["s"], "peak").collect()}
    assert got == {(i, b) for s, i, t in pts for q, a, z, b in iv if s == q and a <= t < z}
    held = {(x.s, x.start): x.n_points for x in intervals.intervals_with_points(i_df, p_df, ["s"], "peak").collect()}
    assert held == {(q, a): n for q, a, z, b in iv if (n := sum(s == q and a <= t < z for s, _, t in pts))}


def test_interpolation_matches_numpy(spark):
    t, v = [0.0, 1.0, 4.0, 6.0], [1.0, 3.0, 0.0, 2.0]
    at = [-1.0, 0, 0.5, 2, 4, 5, 9]
    got = intervals.interpolate_at(spark.createDataFrame([("k", float(x)) for x in at], "s string, at double"), spark.createDataFrame([("k", a, b) for a, b in zip(t, v)], "s string, t double, v double"), ["s"], "at", "t", "v").orderBy("at")
    assert [r.interpolated for r in got.collect()] == pytest.approx(np.interp(at, t, v).tolist())


def test_metadata_is_cleaned_and_coalesced(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,Age,Gender,BMI,Extra\n8631.0,45,F,31.2,x\n {G-1} ,50,M,abc,y\n,1,F,1,z\nnan,1,F,1,z\n7,,nan,20,z\n")
    (tmp_path / "b.csv").write_text("ID,Age,Gender\n7,33,M\n9,60,F\n")
    (tmp_path / "c.csv").write_text("Id2,Age\n1,2\n")
    got = relational.coalesce_union([tables.read_metadata(spark, str(tmp_path / f)) for f in ("a.csv", "b.csv")], "ID").collect()
    assert [tuple(r) for r in got] == [("7", 33.0, "M", 20.0), ("8631", 45.0, "F", 31.2), ("9", 60.0, "F", None), ("{G-1}", 50.0, "M", None)]
    with pytest.raises(tables.SourceError):
        tables.read_metadata(spark, str(tmp_path / "c.csv"))


def test_hypnodensity_argmax_and_bad_cells(spark, tmp_path):
    (tmp_path / "s1_Hypnodensity.csv").write_text("Timestamp,Wake,N1,N2,N3,REM\n2024-01-01 00:00:00,.1,.4,.4,.05,.05\nbad,x,.2,.7,.1,0\n2024-01-01 00:01:00,a,b,c,d,e\n")
    rows = tables.hypnogram(tables.read_hypnodensity(spark, str(tmp_path))).orderBy("epoch_idx").collect()
    assert [(r.subject_id, r.epoch_idx, r.stage, r.code) for r in rows] == [("s1", 0, "N1", 1), ("s1", 1, "N2", 2), ("s1", 2, None, None)]
    assert rows[1].ts is None and rows[2].problem.startswith("unknown stage")


def test_hypnodensity_columns_in_any_order(spark, tmp_path):
    import itertools

    names = ("Wake", "N1", "N2", "N3", "REM")
    for k, order in enumerate(list(itertools.permutations(names))[::11]):
        header = [*order[:2], "Timestamp", *order[2:]] if k % 2 else ["Timestamp", *order]
        rows = [[("2024-01-01" if c == "Timestamp" else "0.9" if c == n else "0.1") for c in header] for n in names]
        (tmp_path / f"s{k}_Hypnodensity.csv").write_text("\n".join(", ".join(r) for r in [[f" {c} " for c in header], *rows]))
    got = tables.read_hypnodensity(spark, str(tmp_path)).orderBy("subject_id", "epoch_idx").collect()
    assert len(got) >= 50 and all(r.stage == names[r.epoch_idx] and r.ts is not None and r.problem is None and r.probabilities[r.stage] == 0.9 for r in got)


def test_hypnodensity_headers_name_the_stages(spark, tmp_path):
    (tmp_path / "a_Hypnodensity.csv").write_text("Timestamp,R,W,Light\n2024-01-01,.4,.4,.2\n2024-01-01,.1,.2,.7\n")
    (tmp_path / "b_Hypnodensity.csv").write_text("Time,W\n2024-01-01,1\n")
    (tmp_path / "c_Hypnodensity.csv").write_text("Timestamp\n2024-01-01\n")
    rows = lambda **more: [(r.subject_id, r.stage, r.problem) for r in tables.read_hypnodensity(spark, str(tmp_path), **more).orderBy("subject_id", "epoch_idx").collect()]
    odd = [("b", None, "no column Timestamp"), ("c", None, "no columns of stages")]
    assert rows() == [("a", "R", None), ("a", "Light", None), *odd]  # of equal ones the first in the file
    assert rows(relabel={"R": "REM"})[:2] == [("a", "REM", None), ("a", "Light", None)]
    assert [x[1] for x in rows(columns=("W", "R"))[:2]] == ["W", "W"]
    assert rows(columns=("W", "N9"))[0] == ("a", None, "no column N9")
    with pytest.raises(Exception, match="no column"):
        rows(strict=True)


def test_scalars(spark):
    df = spark.createDataFrame([(" 12.0 ", float("nan"), 1.0, "N2 "), ("nan", 2.0, 2.0, "0"), (None, None, None, "rem")], "id string, a double, b double, stage string")
    got = df.select(clean_id("id").alias("i"), is_nan("a").alias("n"), first_max("a", "b").alias("m"), stage_code("stage").alias("c")).collect()
    assert [tuple(r) for r in got] == [("12", True, "b", 2), (None, False, "a", 0), (None, False, None, 4)]
    with pytest.raises(Exception, match="unknown stage label"):
        spark.createDataFrame([("N9",)], "s string").select(stage_code("s")).collect()


ALIAS = [("C3", ["C3M2", "C3"]), ("C4", ["C4-M1", "CZM2"]), ("F3", ["F3M2", "FZM2"]), ("F4", ["F4M1", "FZM2"]), ("O1", ["O1M2"])]


def test_channels_are_claimed_in_order(spark):
    labels = {"a": ["C3", " c3m2 ", "C4-M1"], "b": ["FZM2"], "c": ["EMG"]}
    got = {r.subject_id: r for r in relational.resolve_channels(spark.createDataFrame([(s, x) for s, v in labels.items() for x in v], "subject_id string, label string"), ALIAS).collect()}
    assert got["a"].resolved == {"C3": " c3m2 ", "C4": "C4-M1"} and got["a"].missing == ["F3", "F4", "O1"] and got["a"].conflicts == []
    assert got["b"].resolved == {"F3": "FZM2"} and [(c.canonical, c.alias, c.physical, c.claimed_by) for c in got["b"].conflicts] == [("F4", "FZM2", "FZM2", "F3")]
    assert got["b"].missing == ["C3", "C4", "O1"] and got["c"].missing == [c for c, _ in ALIAS]


def test_conflicts_are_all_told_and_the_first_label_counts(spark):
    aliases = [("a", ["X"]), ("b", ["X", "Y"]), ("c", ["Y", "X"])]
    df = spark.createDataFrame([("s", 0, "y"), ("s", 1, "X"), ("s", 2, "x "), ("t", 0, "x "), ("t", 1, "X")], "subject_id string, position int, label string")
    got = {r.subject_id: r for r in relational.resolve_channels(df, aliases, position="position").collect()}
    clash = lambda r: [(c.canonical, c.alias, c.physical, c.claimed_by) for c in r.conflicts]
    assert got["s"].resolved == {"a": "X", "b": "y"} and clash(got["s"]) == [("b", "X", "X", "a"), ("c", "Y", "y", "b"), ("c", "X", "X", "a")]
    assert got["s"].missing == [] and got["s"].unresolved == ["c"] and got["t"].resolved == {"a": "x "}
    with pytest.raises(Exception, match="no channel for"):
        relational.resolve_channels(df, aliases, strict=True).collect()
    exact = relational.resolve_channels(spark.createDataFrame([("s", x) for x in (" A", "b", "C", "C3", "C4")], "subject_id string, label string"), [("C3", ["c3", "C3"]), ("C4", ["C4"]), ("A", ["A"]), ("B", ["B"])], ignore_case=False).first()
    assert exact.resolved == {"C3": "C3", "C4": "C4", "A": " A"} and exact.missing == ["B"]


def test_claims_in_python_and_in_plans_agree(spark):
    r = random.Random(3)
    pool = [x for _, names in recordings.ALIASES for x in names]
    subjects = {f"s{k}": [r.choice([str, str.lower, lambda x: x + " "])(x) for x in r.sample(pool, r.randrange(25))] for k in range(30)}
    df = spark.createDataFrame([(s, k, x) for s, labels in subjects.items() for k, x in enumerate(labels)], "subject_id string, position int, label string")
    got = {x.subject_id: x for x in relational.resolve_channels(df, recordings.ALIASES, position="position").collect()}
    for s, labels in subjects.items():
        if labels:
            resolved, missing, conflicts, unresolved = recordings.claim(labels, recordings.ALIASES)
            x = got[s]
            assert (x.resolved, x.missing, [c.asDict() for c in x.conflicts], x.unresolved) == (resolved, missing, conflicts, unresolved)


def test_spellings_count_where_case_does():
    for label, channel in (("CHIN", "Chin"), ("chin", "Chin"), ("LLEG", "LLeg"), ("Leg/R", "RLeg"), ("THO", "Thorax"), ("Pflo", "PFlow"), ("mmHg", "CO2"), ("rr", "RR")):
        assert recordings.claim([label], recordings.ALIASES, ignore_case=False)[0] == {channel: label}
    assert recordings.claim(["lleg"], recordings.ALIASES, ignore_case=False)[0] == {}


def test_recordings(spark, tmp_path):
    from tidemark.sources import errors

    x = np.sin(np.arange(2560) / 7) * 50
    (tmp_path / "good.edf").write_bytes(edf.write_edf([("C3-M2", 128, x), ("C4", 64, x[:1280]), ("EKG", 128, x)]))
    (tmp_path / "none.edf").write_bytes(edf.write_edf([("nothing", 128, x)]))
    (tmp_path / "bad.edf").write_bytes(b"nothing")
    rows = lambda how, **more: {(r.subject_id, r.channel): r for r in how.load(edf.files(spark, str(tmp_path), **more)).collect()}
    got = rows(recordings.Recordings(requested=["C4", "C3", "O1"], rate=64.0))
    c3, c4 = got[("good", "C3")], got[("good", "C4")]
    assert len(c3.samples) == len(c4.samples) == 1280 and c3.sf == 64.0 and c3.physical == "C3-M2" and (c4.position, c3.position) == (0, 1)
    assert c3.missing == ["O1"] == c3.unresolved and c3.conflicts == []
    assert got[("none", None)].error_type == "ChannelResolutionError" and got[("bad", None)].error_type == "DataLoadError"
    loaded = recordings.Recordings(requested=["C4", "C3", "O1"], rate=64.0).load(edf.files(spark, str(tmp_path)))
    assert [r.subject_id for r in recordings.one_channel(loaded, "C3", strict=True).collect()] == ["good"]
    with pytest.raises(errors.ChannelResolutionError):
        recordings.one_channel(loaded, "O1", strict=True)
    own = rows(recordings.Recordings(requested=["C3", "C4"], mains=None))
    assert own[("good", None)].error_type == "DataLoadError" and "differ in length" in own[("good", None)].error_message
    native = recordings.Recordings(requested=["C4"], mains=None).load(edf.files(spark, str(tmp_path)))
    assert {r.subject_id: r.sf for r in recordings.native_rate(native).collect()} == {"good": 64.0, "none": None, "bad": None}
    assert rows(recordings.Recordings(requested=["C3", "O1"], strict=True, rate=64.0))[("good", None)].error_type == "ChannelResolutionError"
    only = spark.createDataFrame([("good",)], "ID string")
    (tmp_path / "bad.edf").chmod(0)  # isn't opened if it isn't asked for
    assert {s for s, _ in rows(recordings.Recordings(rate=64.0), subjects=only)} == {"good"}
    put_in = recordings.Recordings(aliases=[("one", ["1"])], mains=None, lister=lambda data: ["1"], reader=lambda data, labels: [(labels[0], 8.0, [[1.0, 2.0]])])
    assert rows(put_in, subjects=only)[("good", "one")].samples == [1.0, 2.0]
    for wrong in ({"aliases": []}, {"rate": 0.0}, {"mains": -1.0}, {"rate": 8.0, "reader": len}):
        with pytest.raises(ValueError):
            recordings.Recordings(**wrong)
    with pytest.raises(errors.ChannelResolutionError):
        recordings.Recordings(requested=["Z9"])


def test_ids_paths_and_settings(spark, tmp_path, monkeypatch):
    from tidemark.functions import settings
    from tidemark.sources import errors

    ids = ["a", "", " a", "a/b", "a\\b", "a..b", "a.b", "a\x00b", None]
    got = [r.ok for r in spark.createDataFrame([(x,) for x in ids], "ID string").select(recordings.safe_id("ID").alias("ok")).collect()]
    assert got == [True, False, False, False, False, False, True, False, False]
    with pytest.raises(errors.InvalidSubjectIDError):
        recordings.require_safe(spark.createDataFrame([("../x",)], "ID string"))
    monkeypatch.delenv("TIDE_ROOT", raising=False)
    with pytest.raises(errors.RootError):
        recordings.root_folder("TIDE_ROOT")
    monkeypatch.setenv("TIDE_ROOT", str(tmp_path))
    assert recordings.root_folder("TIDE_ROOT") == str(tmp_path) == settings.expand("$TIDE_ROOT")
    with pytest.raises(errors.FolderNotFoundError):
        recordings.root_folder("TIDE_ROOT", "below")
    for text, yes in (("1", True), (" Yes ", True), ("off", False), ("", False)):
        monkeypatch.setenv("TIDE_FLAG", text)
        assert settings.flag("TIDE_FLAG", True) is yes
    monkeypatch.setenv("TIDE_N", "none")
    assert settings.whole("TIDE_N", 3) is None and settings.whole("TIDE_M", 3) == 3 and settings.count("TIDE_N", 2) == 2
    listing = spark.createDataFrame([("a_H.csv",)], "name string")
    both = spark.createDataFrame([("a",), ("b",)], "ID string")
    assert [r.ID for r in tables.require_files(listing, both, "_H.csv", required=False).collect()] == ["a"]
    with pytest.raises(errors.AnnotationLoadError):
        tables.require_files(listing, both, "_H.csv")


def test_signals_at_one_rate_equal_a_plain_transform(spark):
    x = np.random.default_rng(1).normal(size=64)
    got = fits.resampled(spark.createDataFrame([("a", "c", 64.0, x.tolist())], "subject_id string, channel string, sf double, samples array<double>"), ["subject_id", "channel"], 48.0).first()
    k = np.arange(-24, 25)
    wave = np.exp(-2j * np.pi * np.outer(k, np.arange(64)) / 64) @ x  # the plain sum of each frequency, both signs of the last
    assert np.allclose(got.samples, [(wave * np.exp(2j * np.pi * k * n / 48)).sum().real / 64 for n in range(48)])


def test_edf_round_trip_with_mixed_rates(spark, tmp_path):
    x, y = np.sin(np.arange(1280) / 7) * 50, np.cos(np.arange(1000) / 5) * 20
    (tmp_path / "s1.edf").write_bytes(edf.write_edf([("C3M2", 128, x), ("O1", 100, y)]))
    (tmp_path / "bad.edf").write_bytes(b"nothing")
    ch = {(r.subject_id, r.label): (r.sf, r.error) for r in edf.channels(spark, str(tmp_path)).collect()}
    assert ch[("s1", "C3M2")] == (128.0, None) and ch[("s1", "O1")][0] == 100.0 and ch[("bad", None)][1]
    (tmp_path / "bad.edf").unlink()
    got = {r.channel: r for r in edf.read_signals(spark, str(tmp_path)).collect()}
    assert np.allclose(got["C3M2"].samples, x, atol=0.002) and np.allclose(got["O1"].samples, y, atol=0.002)
    only = edf.read_signals(spark, str(tmp_path), spark.createDataFrame([("s1", {"C3": "C3M2"})], "subject_id string, resolved map<string,string>")).collect()
    assert [(r.channel, r.sf) for r in only] == [("C3", 128.0)]
    out = fits.resampled(edf.read_signals(spark, str(tmp_path)), ["subject_id", "channel"], 64.0).collect()
    assert {len(r.samples) for r in out} == {640} and {r.sf for r in out} == {64.0}


def test_sharding_covers_each_row_once(spark):
    df = spark.range(103).select(F.col("id").cast("string").alias("ID"))
    order = sorted(str(i) for i in range(103))
    for k in range(4):
        assert sorted(r.ID for r in relational.shard(df, "ID", k, 4).collect()) == sorted(order[k::4])


def test_welch_equals_the_kernel(spark):
    from tidemark.functions import kernels

    x = np.random.default_rng(3).normal(size=470).cumsum()
    got = spectra.welch(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "s string, i int, v double"), ["s"], "i", "v").orderBy("k").collect()
    f, p = kernels.welch(x, 1.0)
    assert np.allclose([r.psd for r in got], p, rtol=1e-9) and np.allclose([r.freq for r in got], f)


def test_statistics_of_small_groups(spark):
    rows = [("low", v) for v in (1.0, 2.0, 3.0, float("nan"))] + [("high", v) for v in (4.0, 5.0, 6.0, float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("w", F.lit(1.0))
    got = {r.parameter: r for r in statistics.compare(df, "g", ["v", "w"]).collect()}
    v = got["v"]
    assert (v.test, v.n_low, v.n_high, v.missing_n_low, v.u, v.delta) == ("mannwhitney", 3, 3, 1, 9.0, 1.0)
    assert v.p == pytest.approx(0.1) and v.q is not None and v.hedges_g == pytest.approx(2.4, abs=0.5)
    assert got["w"].delta == 0.0 and got["w"].p == pytest.approx(1.0)
    with pytest.raises(Exception, match="fewer than two"):
        statistics.rate_groups(df.filter("v = 1"), "v").collect()


def test_reasons_first_wins(spark):
    base = dict(subject_id="a", sleep_stage="N2", channel="C3", peak_freq_hz=0.02, peak_period_s=50.0, bandwidth_hz=0.01, auc=1.0, chromatogram_peak_area=0.1, spindle_per_min=1.0, spindle_per_min_SEM=0.1)
    cases = [({}, None), ({"subject_id": "d"}, "duplicate subject"), ({"subject_id": "d", "sleep_stage": "N3"}, "duplicate subject"), ({"sleep_stage": "N3", "auc": -1.0}, "wrong stage"), ({"spindle_per_min": -1.0}, "negative rate"), ({"peak_freq_hz": float("nan")}, "missing peak_freq_hz"), ({"auc": float("inf")}, "infinite auc"), ({"peak_period_s": 51.0}, "period is not 1 / frequency")]
    rows = [base | {"subject_id": f"s{i}"} | c for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "subject_id string, sleep_stage string, channel string, " + ", ".join(f"{k} double" for k in list(base)[3:]))
    got = validation.reasons(df.withColumn("at", F.monotonically_increasing_id()), "N2", "C3").orderBy("at").collect()
    assert [r.exclusion_reason for r in got] == [e for _, e in cases]
    assert "kept: 1" in sinks.validation_text(validation.split(validation.reasons(df, "N2", "C3"))[2], "N2", "C3")


def test_record_problems(spark):
    a = [0.1, 0.2]
    good = (a, a, a, [5.0], [6.0], [5.5], [0.0], [210.0], [1])
    bad = [(a, [0.1], a, *good[3:]), (*good[:5], [7.0], *good[6:]), (*good[:7], [199.0], [1]), (*good[:8], [2]), (None, *good[1:])]
    df = spark.createDataFrame([good, *bad], "freqs array<double>, raw_mean array<double>, corr_mean array<double>, spindle_start array<double>, spindle_stop array<double>, spindle_peak array<double>, bout_start array<double>, bout_stop array<double>, bout_n_spindles array<long>")
    got = [r.p for r in df.select(validation.record_problems().alias("p")).collect()]
    assert [x[:1] for x in got] == [[], ["spectrum lengths differ"], ["spindle out of order"], ["bout too short"], ["spindles of bouts don't add up"], ["missing freqs"]]


def test_sleep_statistics_by_hand(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([0, 0, 1, 2, 0, 2, 4, 0])], "subject_id string, epoch_idx int, code int")
    r = sleep.statistics(df).first().asDict()
    assert (r["TIB"], r["SPT"], r["WASO"], r["TST"], r["SOL"], r["Lat_REM"], r["N2"], r["N3"]) == (4.0, 2.5, 0.5, 2.0, 1.0, 3.0, 1.0, 0.0)
    assert r["Lat_N3"] is None and r["SE"] == 50.0 and r["SME"] == 80.0 and len(r) == 22


def test_event_rate_error_of_one_bout_is_zero(spark):
    df = spark.createDataFrame([("a", 0.0, 300.0, 5), ("b", 0.0, 300.0, 5), ("b", 400.0, 700.0, 15)], "s string, start double, stop double, n_spindles int")
    got = {r.s: (r.rate, r.rate_sem) for r in sleep.event_rate(df, ["s"]).collect()}
    assert got["a"] == (1.0, 0.0) and got["b"] == pytest.approx((2.0, math.sqrt(2) / math.sqrt(2)))


def test_spread_statistics_equal_those_of_one_task(spark, monkeypatch):
    r = random.Random(8)
    rows = [(r.choice("ab"), r.choice(["low", "high"]), float(r.choice([r.randrange(20), r.uniform(0, 20)]))) for _ in range(500)] + [("a", "low", float("nan"))]
    df = spark.createDataFrame(rows, "g string, s string, v double")

    def everything():
        ranks = statistics.midranks(df.filter("not isnan(v)"), "v", ["g"]).select("g", "v", "rank").distinct()
        tables_ = [statistics.describe(df, ["g"], "v"), statistics.describe(df, [], "v"), statistics.mann_whitney(df, "s", "v", "low", "high"), statistics.mann_whitney(df, "s", "v", "low", "high", ["g"]), statistics.kruskal(df, "g", "v"), ranks]
        return [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in t.collect()) for t in tables_]

    one = everything()
    monkeypatch.setattr(statistics, "ONE_TASK_BYTES", 0)
    assert everything() == one
    values = np.array([v for g, _, v in rows if g == "a" and v == v])
    assert statistics.quantiles(df, ["g"], "v", (0.1, 0.5, 1.0)).filter("g = 'a'").first().quantiles == pytest.approx(np.quantile(values, [0.1, 0.5, 1.0]).tolist())


def test_paired_and_pairwise_p(spark):
    from tidemark.functions import tails

    x, y = [3.0, 1.0, 4.0, 1.5, 9.0], [2.0, 2.5, 1.0, 1.0, 3.0]
    r = statistics.paired(spark.createDataFrame(list(zip("abcde", x, y)), "s string, x double, y double"), "s", "x", "y").first()
    w, p, effect = tails.wilcoxon(np.array(x) / np.mean(x) - np.array(y) / np.mean(y))
    assert (r.w, r.p, r.effect) == pytest.approx((w, p, effect))
    groups = {"a": [1.0, 2.0, 3.0, 9.0], "b": [4.0, 5.0, 6.5], "c": [2.5, 7.0, 8.0, 10.0, 11.0]}
    got = {(r.a, r.b): r for r in statistics.pairwise(spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double"), "g", "v").collect()}
    for (a, b), r in got.items():
        u, p = tails.mann_whitney(np.array(groups[a]), np.array(groups[b]))
        assert (r.u, r.p) == pytest.approx((u, p)) and r.p_holm >= r.p
    assert len(got) == 3


def test_crop_keeps_both_ends(spark):
    df = spark.createDataFrame([([0.0, 0.01, 0.05, 0.1, 0.2], [1.0, 2.0, 3.0, 4.0, 5.0])], "freqs array<double>, corr_mean array<double>")
    assert tuple(spectra.crop(df, 0.01, 0.1).first()) == ([0.01, 0.05, 0.1], [2.0, 3.0, 4.0])


def test_ranks_of_values_that_an_aggregate_makes_anew_each_time(spark, monkeypatch):
    """Values whose last bits change from evaluation to evaluation, as those of sums do: nothing may be lost between two of them."""
    for limit in (statistics.ONE_TASK_BYTES, 0):
        monkeypatch.setattr(statistics, "ONE_TASK_BYTES", limit)
        noisy = spark.range(400, numPartitions=4).select(F.when(F.col("id") % 2 == 0, "low").otherwise("high").alias("g"), (F.col("id") % 50 - 20.25 + uniform() * 1e-9).alias("v"))
        r = statistics.mann_whitney(noisy, "g", "v", "low", "high").first()
        assert (r.n_low, r.n_high) == (200, 200)
        r = statistics.signed_ranks(noisy, "v").first()
        assert r.n == 400 and r.w_plus + r.w_minus == 400 * 401 / 2
        r = statistics.compare(noisy, "g", ["v"]).first()
        assert (r.n_low, r.n_high) == (200, 200) and r.ties == 0


def uniform():
    """Other numbers each time that a plan is run."""
    return F.udf(lambda: __import__("random").random(), "double").asNondeterministic()()


def test_ordered_means_have_the_bits_of_a_serial_average(spark):
    rows = [(g, i, round(((i * 7919 + g) % 1000) / 7 * 10 ** (i % 5), 2)) for g in range(20) for i in range(200)]
    want = {}
    for g, i, v in rows:
        want[g] = want.get(g, 0.0) + v
    for seed in (1, 2):
        df = spark.createDataFrame(rows, "g long, i long, v double").orderBy(F.rand(seed)).repartition(7)
        got = statistics.ordered_means(df, ["g"], ["i"], m=F.col("v"), e=F.when(F.col("i") % 2 == 0, F.col("v")))
        assert {r.g: (r.n, r.m) for r in got.collect()} == {g: (200, s / 200) for g, s in want.items()}
    none = statistics.ordered_means(spark.createDataFrame([(1, 1, None)], "g long, i long, v double"), ["g"], ["i"], m=F.col("v")).first()
    assert (none.n, none.m) == (1, None)


def test_rows_are_compared_with_their_groups_figures_where_they_are(spark, monkeypatch):
    """A large table of few groups isn't shuffled by group, which would give a task a whole group."""
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") == 3, 1e6).otherwise(F.col("id") % 100).cast("double").alias("v"))
    want = statistics.describe(df, ["g"], "v").orderBy("g").collect()
    assert [r.outliers for r in want] == [1, 0, 0]
    monkeypatch.setattr(statistics, "ONE_TASK_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = statistics.describe(df, ["g"], "v")
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert got.orderBy("g").select("g", "n", "median", "q1", "q3", "outliers").collect() == [tuple(r[c] for c in ("g", "n", "median", "q1", "q3", "outliers")) for r in want]
        monkeypatch.setattr(statistics, "FEW_GROUPS", 2)
        assert [r.outliers for r in statistics.describe(df, ["g"], "v").orderBy("g").collect()] == [1, 0, 0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
