"""A test for each finding of the third round that was right: each failed, or took far too much, before."""

import os
import random
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from oracle import agree, views
from strata.llm import jaccard
from strata.llm import windows as W
from strata.operators import ann, code, indexing, notes, ranges, search, words
from strata.plans import code_queries, reference_queries
from strata.plans.knowledge import NOW
from strata.functions import text as T
from strata.plans.queries import ORACLE_SQL, QUERIES
from strata.sources import tables
from strata.streaming import streams


def folder(tmp_path, **made):
    """A folder of tables from DuckDB's queries, one file each."""
    for name, sql in made.items():
        duckdb.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def holds(spark, name, sf_dir):
    agree(QUERIES[name](spark, sf_dir), views(sf_dir), ORACLE_SQL[name])


def test_dispatches_of_one_time_and_number(spark, tmp_path):
    rows = [(o, 1 + i % 2, "R" if (o + i) % 5 < 2 else "A") for i in range(6) for o in range(40)]
    values = ", ".join(f"({o}::BIGINT, {n}::INT, '{f}', 'O', TIMESTAMP '2020-01-0{1 + o % 2}')" for o, n, f in rows)
    sf_dir = folder(
        tmp_path,
        lineitem=f"SELECT * FROM (VALUES {values}) t(l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate)",
        orders="SELECT i AS o_orderkey, 'P' AS o_orderstatus, TIMESTAMP '2020-01-01' AS o_orderdate FROM range(45) t(i)",
    )
    holds(spark, "dispatch_status", sf_dir)


def test_sketch_has_cells_for_six_gigabytes():
    """One cell or two for each window of six GB of text; cells that lie far apart travel in less than two bytes."""
    bits, _ = W.sketch_size(6 << 30, jaccard.SKETCH_BITS)
    assert 1 << bits >= (6 << 30) // 6
    rng = np.random.default_rng(3)
    for n in (0, 1, 2000, 50000):
        cells = np.unique(rng.integers(0, 1 << W.BLOCK_BITS, n))
        assert np.array_equal(W._ungaps(W._gaps(cells)), cells) and len(W._gaps(cells)) < 100 + 2 * n


def test_sums_over_ranges(spark, monkeypatch):
    """Sums over points in intervals and over overlapping intervals are those of the joins, and no pairs are made."""
    rng = random.Random(5)
    spot = lambda: rng.choice([None, rng.uniform(-9, 9), float(rng.randrange(-5, 5)), 1e300])
    a = spark.createDataFrame([(i % 40, spot(), spot()) for i in range(120)], "k long, lo double, hi double")
    b = spark.createDataFrame([(i, spot(), spot(), 1) for i in range(150)], "first long, lo2 double, hi2 double, n long")
    of = lambda df: sorted((r["k"], r["n"], r["first"]) for r in df.groupBy("k").agg(F.sum("n").alias("n"), F.min("first").alias("first")).collect())
    points, overlaps = of(ranges.range_join(b, a, "lo2", "lo", "hi")), of(ranges.overlap_join(a, b, "lo", "hi"))
    monkeypatch.setattr(ranges, "range_join", None)
    assert of(ranges.range_sums(b, a, "lo2", "lo", "hi", ["k"], ("n",), ("first",))) == points and len(points) > 20
    assert of(ranges.overlap_sums(a, b, "lo", "hi", ["k"], ("n",), ("first",))) == overlaps and len(overlaps) > 20
    assert ranges.range_sums(b.limit(0), a, "lo2", "lo", "hi", ["k"], ("n",), ("first",)).count() == 0
    for name in ("range_join_binned", "overlap_join_binned"):
        holds(spark, name, "/root/testdata/sf0.001")


def test_hits_are_marked_by_equal_joins(spark, capsys):
    """Any number of hits: no row holds them all and no name is compared with each; both forms give the same."""
    shown = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", None), ("y", "a")], "id string, path string")
    asked = spark.createDataFrame([("r", "q")], "repo_id string, query_tokens string")
    named = spark.createDataFrame([("x",), ("x",), ("c",), ("b",), ("z",)], "target string")
    got = notes.mark_rows_useful(asked, shown, named, NOW)
    want = sorted([("a",), ("x",), ("c",), (None,), ("b",), ("x",), ("z",)], key=repr)
    assert sorted(map(tuple, got.select("target").collect()), key=repr) == want
    one = asked.crossJoin(shown.agg(F.collect_list(F.struct("id", "path")).alias("hits")))
    assert sorted(map(tuple, notes.mark_hits_useful(one, named, NOW).select("target").collect()), key=repr) == want
    QUERIES["mark_hits_useful"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "collect_list" not in plan and "target#" in plan
    holds(spark, "mark_hits_useful", "/root/testdata/sf0.001")


def test_vectors_meet_in_groups(spark, capsys, monkeypatch):
    """No pair of a vector and a query is a row; results do not depend on how vectors and queries are dealt; copies tie by key."""
    rng = np.random.default_rng(6)
    made = [(i, [1.0, 2.0, 3.0, 4.0] if i % 9 == 0 else rng.standard_normal(4).tolist()) for i in range(200)]
    df = spark.createDataFrame(made, "id long, v array<float>")
    asked = df.where("id < 20").select(F.col("id").alias("q"), "v")
    index = ann.buckets(df, "id", "v", 4)
    runs = lambda: [sorted(map(tuple, x.select("q", "id", "rank").collect())) for x in (ann.exact(df, asked, "id", "v", "q", 5), ann.search(index, df, asked, "id", "v", "q", 4, 5, most=37))]
    whole = runs()
    assert [i for q, i, _ in whole[0] if q == 9] == [0, 9, 18, 27, 36] and len(set(whole[0]) & set(whole[1])) > 95
    monkeypatch.setattr(ann, "PART", 30)
    monkeypatch.setattr(ann, "BLOCK", 7)
    assert runs() == whole
    ann.exact(df, asked, "id", "v", "q", 5).explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_each_file_is_scanned_once(spark, tmp_path):
    """References, unused names and the meaning of a name take one scan of each file; the files' own scans are counted."""
    files = spark.createDataFrame([(f"a/{i}.py", "python", f"class A{i}:\n    def f(self):\n        return A{i}.g()\n    def g(self): pass\n") for i in range(6)], "path string, language string, text string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def once(text):
        seen.add(1)
        return text

    counted = files.withColumn("text", once.asNondeterministic()("text"))
    known = code.scanned(counted)
    used = code.references_of(known)
    assert {r["target"] for r in used.where("role = 'call'").collect()} == {f"A{i}.g" for i in range(6)}
    assert code.symbols_of(known).count() == 18 and seen.value == 6
    assert sorted(used.collect()) == sorted(code.references(files).collect())
    found = code.symbols(counted).withColumn("full_name", F.concat_ws(".", "container", "name"))
    assert code.resolve(found, "a3.F") == "A3.f" and seen.value == 12
    for text in ("f", "none"):
        with pytest.raises(LookupError):
            code.resolve(found, text)


def test_files_are_scanned_in_many_tasks(spark):
    """A table of few bytes is one file split, but each of its rows is a source file to scan."""
    for made in (code_queries._sources, reference_queries._files):
        assert made(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 64


def test_terms_are_grouped_in_their_text(spark, capsys, monkeypatch):
    """A text's terms take no shuffle, whatever parts its batch is grouped in; counts, weights and places are those of its words."""
    rows = [(1, "a b a", "B c"), (2, None, ""), (3, "", "Reading readings"), (4, "x_1 X_1", None), (5, None, None)]
    docs = spark.createDataFrame(rows, "id long, t string, u string")
    want_tf = {(1, 4 + 1, "a", 8.0), (1, 5, "b", 5.0), (1, 5, "c", 1.0), (3, 2, "reading", 1.0), (3, 2, "readings", 1.0), (4, 2, "x_1", 8.0)}
    for part in (words.PART, 1, 2):
        monkeypatch.setattr(words, "PART", part)
        found = search.postings(docs, "id", {"t": 4.0, "u": 1.0})
        assert {tuple(r) for r in found.select("id", "length", "term", "tf").collect()} == want_tf
        placed = words.own_terms(docs, "id", {"t": 1.0, "u": 1.0}, placed=True)
        assert sorted(r["length"] for r in placed.collect()) == [0, 0, 2, 2, 5]
        at = {(r["id"], r["term"]): [p >> 4 for p in r["places"]] for r in words.each_term(placed, "id").collect()}
        assert at[1, "a"] == [1, 3] and at[1, "b"] == [2, 5] and at[1, "c"] == [6]
    stemmed = search.postings(docs, "id", {"t": 1.0, "u": 1.0}, stemmed=True).where("id = 3").collect()
    assert [(r["term"], r["tf"]) for r in stemmed] == [("read", 2.0)]
    found.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_large_tables_are_shuffled_to_more_tasks(spark):
    assert tables.parts(spark, 1000) == () and tables.parts(spark, 6 << 30) == (768,)


def test_postings_are_verified_in_one_shuffle(spark, capsys):
    """Repeats count, and neither side is compared with the whole other one."""
    kind = "id long, length int, term string, tf double"
    derived = spark.createDataFrame([(1, 2, "a", 1.0), (1, 2, "a", 1.0), (2, 1, "b", 1.0)], kind)
    index = spark.createDataFrame([("b", 2.0, 2, 1), ("a", 1.0, 1, 2), ("z", 1.0, 7, 1), ("z", 1.0, 7, 1)], "term string, tf double, id long, length int")
    found = indexing.verify_postings(index, derived)
    assert tuple(found.first()) == (2, 3) and tuple(indexing.verify_postings(derived, derived).first()) == (0, 0)
    assert tuple(indexing.verify_postings(derived.limit(0), derived.limit(0)).first()) == (0, 0)
    found.explain()
    assert capsys.readouterr().out.count("hashpartitioning") == 1


def test_replay_is_written_by_many_tasks(spark):
    rows = spark.range(300).repartition(6).withColumn("no", F.col("id") % 3)
    folder, schema = streams.replayed(rows, 3, F.col("no"), files=None)
    assert sum(name.endswith(".parquet") for name, *_ in tables.listing(spark, folder)) > 4 * 4
    assert spark.read.schema(schema).parquet(folder).count() == 400


def test_identifiers_without_parts_are_not_split(spark):
    texts = ["fooBar HTTPServer x1 plain _a a_ __ a_b_c \u00c9t\u00e9 9", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.split_identifiers(F.col("t"))).collect()]
    assert got == ["fooBar foo bar HTTPServer http server x1 x 1 plain _a a_ __ a_b_c a b c \u00e9t\u00e9 9", "", ""]


def test_searches_and_logs_hold(spark):
    for name in ("import_log", "verify_postings", "fts_maintenance"):
        holds(spark, name, "/root/testdata/sf0.001")
