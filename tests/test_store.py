"""The keyed store: replaced by key, whole or nothing, and writers side by side."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources.store import Store, read_rows


def rows(spark, *of):
    return spark.createDataFrame(list(of), "who string, stage string, v long, xs array<long>")


def held(store, **more):
    return sorted((r.who, r.stage, r.v) for r in store.read(**more).collect())


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("part-*")}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "t"), "who", "stage", buckets=3)


def test_one_subject_is_replaced_and_no_other_file_changes(spark, store, tmp_path):
    assert store.read() is None
    store.write(rows(spark, ("a", "N2", 1, [1]), ("a", "N3", 2, []), ("b", "N2", 3, None), ("S 2", "N2", 4, [4])))
    before = files(tmp_path / "t")
    store.write(rows(spark, ("a", "N2", 5, [5])))
    assert held(store) == [("S 2", "N2", 4), ("a", "N2", 5), ("a", "N3", 2), ("b", "N2", 3)]
    after = files(tmp_path / "t")
    assert before.items() <= after.items() and len(after) > len(before)
    # a subject that failed this time has no rows, and its earlier ones go
    store.write(rows(spark).limit(0), spark.createDataFrame([("b", "N2")], "who string, stage string"))
    assert held(store) == [("S 2", "N2", 4), ("a", "N2", 5), ("a", "N3", 2)]
    store.write(rows(spark, ("b", "N2", 6, [])))
    assert held(store, key="b") == [("b", "N2", 6)] and held(store, key="S 2") == [("S 2", "N2", 4)] and held(store, key="none") == []
    assert [c.rows for c in store.commits()] == [4, 1, 0, 1]


def test_what_breaks_off_changes_nothing(spark, store, monkeypatch):
    store.write(rows(spark, ("a", "N2", 1, [1])))
    bad = rows(spark, ("a", "N2", 2, [2]), ("b", "N2", 0, [])).withColumn("v", F.when(F.col("v") == 0, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        store.write(bad)
    assert held(store) == [("a", "N2", 1)]
    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("the driver is gone")))
        with pytest.raises(RuntimeError):
            store.write(rows(spark, ("a", "N2", 3, [3])))
    assert held(store) == [("a", "N2", 1)]
    assert len(store.clear(uncommitted=True)) >= 1 and held(store) == [("a", "N2", 1)]
    store.write(rows(spark, ("a", "N2", 4, [4])))
    assert held(store) == [("a", "N2", 4)]


def test_two_shards_at_once(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    store.write(rows(spark, *((f"s{k}", "N2", k, [k]) for k in range(20))))
    write = lambda part: store.write(rows(spark, *((f"s{k}", "N2", 100 + k, [k]) for k in range(20) if k % 4 == part)))
    with ThreadPoolExecutor(4) as pool:
        commits = list(pool.map(write, range(4)))
    assert len({c.name for c in commits}) == 4
    assert held(store) == sorted((f"s{k}", "N2", 100 + k) for k in range(20))


def test_writers_see_each_other_through_a_compaction(spark, store, monkeypatch):
    store.write(rows(spark, ("a", "N2", 1, []), ("b", "N2", 1, [])))
    store.write(rows(spark, ("a", "N2", 2, [])))
    own = Store._commit
    late = []

    def other_first(self, *a):  # another writer commits between the compaction's read and its commit
        if not late:
            late.append(1)
            store.write(rows(spark, ("b", "N2", 3, []), ("c", "N2", 3, [])))
        return own(self, *a)

    monkeypatch.setattr(Store, "_commit", other_first)
    store.compact()
    want = [("a", "N2", 2), ("b", "N2", 3), ("c", "N2", 3)]
    assert held(store) == want and len(store.commits()) == 2
    assert len(store.clear()) == 2 and held(store) == want
    store.compact()
    assert held(store) == want and len(store.commits()) == 1
    store.write(rows(spark, ("b", "N2", 4, [])))
    assert held(store) == [("a", "N2", 2), ("b", "N2", 4), ("c", "N2", 3)]


def test_figures_are_counted_as_rows_are_written(spark, store):
    c = store.write(rows(spark, ("a", "N2", 1, [1, 2]), ("b", "N2", 2, [3])), figures={"xs": F.sum(F.size("xs")), "big": F.count_if(F.col("v") > 1)})
    assert c.figures == {"rows": 2, "xs": 3, "big": 1} and store.history()[0].figures == c.figures
    assert store.write(rows(spark).limit(0), figures={"xs": F.sum(F.size("xs"))}).figures == {"rows": 0, "xs": 0}


def test_columns_that_came_later_are_null_before(spark, store):
    store.write(rows(spark, ("a", "N2", 1, [1])))
    store.write(rows(spark, ("b", "N2", 2, [2])).withColumn("more", F.lit("x")))
    assert sorted((r.who, r.more) for r in store.read().collect()) == [("a", None), ("b", "x")]


def test_plain_folders_are_read_as_they_are(spark, tmp_path):
    rows(spark, ("a", "N2", 1, [1])).write.partitionBy("stage").parquet(str(tmp_path / "plain"))
    assert read_rows(spark, str(tmp_path / "plain"), "who", "stage").count() == 1
    s = Store(spark, str(tmp_path / "csv"), "who", fmt="csv", buckets=1)
    s.write(rows(spark, ("a", "N2", 1, [])).drop("xs"))
    s.write(rows(spark, ("a", "N3", 2, []), ("b", "", 3, [])).drop("xs"))
    assert [(r.who, r.v) for r in read_rows(spark, str(tmp_path / "csv"), "who", fmt="csv").orderBy("who").collect()] == [("a", 2), ("b", 3)]
