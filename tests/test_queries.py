"""Every registered query against its SQL on the smallest tables."""

import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import tails
from tidemark.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    assert rows
    if name in registry.ORACLE:
        got = duck.execute(registry.ORACLE[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in got.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def write(spark, folder, name, rows, schema, seed=None):
    """A table of a few rows in files; with a seed shuffled."""
    df = spark.createDataFrame(rows, schema)
    df = df.repartition(5).orderBy(F.rand(seed)) if seed is not None else df.coalesce(1)
    df.write.parquet(f"{folder}/{name}.parquet")


def test_halves_are_rounded_alike_however_rows_lie(spark, tmp_path):
    """Differences of means that end in exactly one half: plain sums leave to the order of rows where they go."""
    r, rows, want = random.Random(3), [], []
    for customer in range(300):
        cents = [r.randrange(10_000, 50_000_000) for _ in range(10)]
        cents += r.sample(cents, 10)
        cents[0] += 1000 * r.randrange(5) + 500
        totals = [0.0, 0.0]
        for k, c in enumerate(cents):
            rows.append((len(rows), customer, "FO"[k // 10], c / 100))
            totals[k // 10] += c / 100
        d = totals[0] / 10 - totals[1] / 10
        want.append(math.copysign(math.floor(abs(d) + 0.5), d))
    got = []
    for seed in (1, 2, 3):
        write(spark, f"{tmp_path}/{seed}", "orders", rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double", seed)
        got.append(tuple(registry.QUERIES["wilcoxon_w"](spark, f"{tmp_path}/{seed}").first()))
    assert got[0] == got[1] == got[2]
    assert got[0][2] == tails.wilcoxon(np.array(want))[0]


def test_spectra_of_any_balance(spark, duck, tmp_path):
    balances = [0.0, -0.0, -0.01, 0.01, 1e300, -1e300, math.nan, math.inf, None]
    rows = [(k, b) for k, b in enumerate(b for b in balances for _ in range(9))]
    write(spark, tmp_path, "customer", [(None, 1.0), (-2, -1.0), *rows], "c_custkey long, c_acctbal double")
    got = {tuple(r) for r in registry.QUERIES["spectrum_checks"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == set(c.execute(registry.ORACLE["spectrum_checks"]).fetchall()) and len(got) == 83
