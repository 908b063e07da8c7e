import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import ann, catalog, graph, ranges
from strata.sources import sqlite, tables


def test_range_join(spark, capsys):
    rng = random.Random(2)
    points = [(i, rng.choice([None, rng.uniform(-50, 50), float(rng.randrange(-9, 9))])) for i in range(200)] + [(0, 1.0)]
    spans = [(i, lo, lo + rng.choice([0, -1, 1e-9, 0.5, 1, 3, 64, 1e6])) for i in range(60) for lo in (rng.uniform(-60, 60), float(rng.randrange(-9, 9)))] + [(99, None, 1.0), (98, 1.0, None)]
    a, b = spark.createDataFrame(points, "p long, x double"), spark.createDataFrame(spans, "s long, lo double, hi double")
    got = ranges.range_join(a, b, "x", "lo", "hi")
    want = sorted((p, s) for p, x in points for s, lo, hi in spans if None not in (x, lo, hi) and lo <= x < hi)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == want and set(got.columns) == {"p", "x", "s", "lo", "hi"}
    got.explain()
    assert "NestedLoop" not in capsys.readouterr().out
    assert ranges.range_join(a, b.limit(0), "x", "lo", "hi").count() == 0
    c = b.select("s", "lo", "hi")
    d = b.select(F.col("s").alias("t"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = sorted((x[0], y[0]) for x in spans for y in spans if None not in x and None not in y and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    assert sorted((r["s"], r["t"]) for r in ranges.overlap_join(c, d, "lo", "hi").collect()) == both


def strong(edges):
    """Components by reachability, plainly."""
    nodes = {n for e in edges for n in e}
    after = {n: {b for a, b in edges if a == n} for n in nodes}
    for _ in nodes:
        for n in nodes:
            after[n] |= {x for m in after[n] for x in after[m]}
    return {n: max({m for m in after[n] if n in after[m]} | {n}) for n in nodes}


@pytest.mark.parametrize("n", [0, 12, 30])
def test_components(spark, n):
    rng = random.Random(n)
    edges = [(f"{rng.randrange(20):02}", f"{rng.randrange(20):02}") for _ in range(n)]
    got = graph.components(spark.createDataFrame(edges, "src string, dst string"))
    assert {r["node"]: r["component"] for r in got.collect()} == strong(edges)


def test_vectors(spark):
    rng = np.random.default_rng(4)
    middles = rng.standard_normal((20, 16))
    vectors = [(i, (middles[i % 20] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(400)] + [(900, None), (901, [0.0] * 16), (902, [1.0])]
    df = spark.createDataFrame(vectors, "id long, v array<float>")
    asked = df.where("id < 40").select(F.col("id").alias("q"), "v")
    near = ann.search(ann.buckets(df, "id", "v", 16), df, asked, "id", "v", "q", 16, 5, most=4, tables=8)
    scan = ann.exact(df, asked, "id", "v", "q", 5)
    got, want = ({(r["q"], r["id"]): round(r["similarity"], 6) for r in x.collect()} for x in (near, scan))
    assert len(want) == 200 and len(got.keys() & want.keys()) >= 190 and all(want[k] == got[k] for k in got.keys() & want.keys())
    assert ann.search(ann.buckets(df, "id", "v", 16), df, asked.limit(0), "id", "v", "q", 16).count() == 0


def test_sqlite(spark, tmp_path, capsys):
    rows = [(i, None if i % 5 == 0 else f"n'{i}\"", i / 4, bytes([i % 256]), i % 3 == 0) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "id int, name string, price double, raw binary, flag boolean").repartition(3)
    folder = f"file:{tmp_path}/db"
    assert sum(r["rows"] for r in sqlite.write(df, folder, "t", "id", ("name",)).collect()) == 100
    back = sqlite.read(spark, folder, "t", 4)
    assert back.dtypes == [("id", "bigint"), ("name", "string"), ("price", "double"), ("raw", "binary"), ("flag", "string")]
    assert sorted(map(tuple, back.select("id", "name", "price", "raw").collect())) == sorted((i, n, p, bytearray(b)) for i, n, p, b, _ in rows)
    for condition in ("id > 40 and id <= 60", "name = 'n''7\"'", "name is null", "id in (3, 5, 500)", "name like 'n''1%'", "price * 2 > 45", "id = 1 or name is null", "name <=> null", "id <> 4"):
        assert back.where(condition).count() == df.where(condition).count(), condition
    back.where("id > 40").explain("formatted")
    assert "GreaterThan(id,40)" in capsys.readouterr().out
    db = catalog.Registry()
    db.add_spec(f"lite=sqlite:{folder}")
    assert [r["primary_key"] for r in catalog.describe(spark, db.get("LITE"), "t").orderBy("ordinal").collect()] == [True, False, False, False, False]
    assert [(r["index"], r["column"]) for r in sqlite.indexes(spark, folder, "t").collect()] == [("t_name", "name")] and db.listing(spark).first()["reachable"]
    empty = f"{tmp_path}/none"
    sqlite.write(df.limit(0).coalesce(1), empty, "t")
    assert sqlite.read(spark, empty, "t").count() == 0


def test_numbers(spark):
    df = spark.createDataFrame([(i * 37 % 101, "x") for i in range(101)], "k long, v string").repartition(5)
    got = tables.numbered(df, ["k"], "id", 10)
    assert sorted((r["id"], r["k"]) for r in got.collect()) == [(i + 10, i) for i in range(101)]
    assert tables.numbered(df.limit(0), ["k"], "id").count() == 0
