"""The corpus pipeline, stage by stage, against plain Python."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm import op1_quality, op4_simhash, queries

from .test_ops import check_classes, leaks

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before the first stage and after each."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_keep_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert {"ids", "token_ends"} <= set(stages[-1].columns)


def test_stages_decide_as_plain_python(spark, stages):
    model = op1_quality.fit(stages[0], spark.read.parquet(f"{DIR}/labels.parquet"))
    good = {r.doc_id for r in op1_quality.score(stages[0], model).filter("predicted = 1").collect()}
    assert {i for i, _ in rows(stages[1])} == good
    before, found = rows(stages[1]), {r.doc_id: r.component_id for r in op4_simhash.similar(stages[1]).collect()}
    check_classes([t for _, t in before], [found[i] for i, _ in before])
    assert rows(stages[2]) == [(i, t) for i, t in before if found[i] == i] and len(set(found.values())) < len(before)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    clean = {r[0] for r in leaks(rows(stages[2]), bench) if not r[5]}
    assert rows(stages[3]) == [(i, t) for i, t in rows(stages[2]) if i in clean] and len(clean) < stages[2].count()
    assert not any(re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", t) for _, t in rows(stages[4])) and stages[4].count() == stages[3].count()
    assert stages[4].filter(F.length("text") != F.col("n_chars")).count() == 0
    assert stages[5].count() == stages[4].count() and stages[5].filter("size(ids) = 0 AND text <> ''").count() == 0


def test_run_gives_the_same(spark, stages):
    assert {r.doc_id for r in corpus_pipeline.run(spark, DIR).select("doc_id").collect()} == {r.doc_id for r in stages[-1].select("doc_id").collect()}


def test_stages_take_odd_rows_and_empty_tables(spark, docs, no_docs, rows_of_texts, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns that clash with those of operators, and no rows at all."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    leak = " ".join(rows_of_texts[8][1].split()[:12])
    spark.createDataFrame([(1, leak, 5)], "item_id long, text string, key long").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, start in enumerate((docs.withColumn("ids", F.lit("old")), no_docs)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{k}-{name}")
            before, now = now, spark.read.parquet(f"{tmp_path}/{k}-{name}")
            assert now.count() <= before.count() and (name == "tokens" or now.columns == before.columns), name
        left = {r.doc_id for r in now.collect()}
        assert {"ids", "token_ends"} <= set(now.columns) and (not left if k else None in left and 8 not in left and 0 in left)
        assert now.filter("ids is null").count() == 0


@pytest.fixture(scope="module")
def rows_of_texts(texts):
    return list(enumerate(texts))


def test_queries_match_their_sql(spark):
    import duckdb

    c = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, DIR)
        want = c.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert sorted(tuple(r[x] for x in columns) for r in got.collect()) == sorted(want.fetchall())


def test_a_run_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch, stages):
    """A stage that failed is done again; those before it aren't."""
    called = []

    def noted(name, stage, fail):
        def run(spark, docs, sf_dir):
            called.append(name)
            if fail and called.count(name) == 1:
                raise RuntimeError("lost")
            return stage(spark, docs, sf_dir)

        return run

    keep = lambda name: lambda spark, docs, sf_dir: docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, noted(n, keep(n), n == "c")) for n in "abcd"])
    folder = f"file://{tmp_path}/run"
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, DIR, folder)
    got = corpus_pipeline.run(spark, DIR, folder)
    assert called == ["a", "b", "c", "c", "d"] and rows(got) == rows(stages[0])
    assert corpus_pipeline.run(spark, DIR, folder).count() == got.count() and len(called) == 5
    assert [p.name for p in (tmp_path / "run").iterdir()] == ["3-d"]
