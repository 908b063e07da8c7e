import datetime as dt
import hashlib
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from strata.operators import indexing
from strata.operators.store import Store
from strata.streaming import indexed, state, streams


def _events(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:09"), (2, "2024-01-01 00:00:00"), (2, "2024-01-01 03:00:00"), (1, "2024-01-01 03:00:00")]
    return spark.createDataFrame(rows, "k int, t string").select("k", F.to_timestamp("t").alias("ts"))


def test_streams_equal_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    _events(spark).coalesce(1).write.parquet(source)
    batch = spark.read.parquet(source)
    for i, f in enumerate((lambda d: streams.debounced(d, "k"), lambda d: streams.rolling(d, "ts", "1 hour", "30 minutes"))):
        stream = f(streams.watch(spark, source, batch.schema))
        got = {tuple(r) for r in streams.drain(stream, f"s{i}", str(tmp_path / f"c{i}"), "complete").collect()}
        assert got == {tuple(r) for r in f(batch).collect()}
    deduped = streams.deduplicated(streams.watch(spark, source, batch.schema), ["k"], "ts", "1 day")
    assert streams.drain(deduped, "s9", str(tmp_path / "c9")).count() == 2


def _write(spark, folder, rows):
    spark.createDataFrame(rows, "k int, ts int, v string").coalesce(1).write.mode("append").parquet(folder)


def test_the_newest_row_wins_whenever_it_comes(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k int, ts int, v string"
    run = lambda checkpoint: streams.upsert_stream(streams.watch(spark, source, schema, 1), target, ["k"], ["ts"], str(tmp_path / checkpoint), buckets=4)
    table = lambda: {r["k"]: r["v"] for r in streams.latest(spark, target).collect()}
    assert streams.latest(spark, target) is None
    _write(spark, source, [(i, 10, f"new {i}") for i in range(20)])
    run("a")
    _write(spark, source, [(3, 5, "late"), (4, 11, "newer"), (99, 1, "other")])
    run("a")
    want = {i: f"new {i}" for i in range(20)} | {4: "newer", 99: "other"}
    assert table() == want
    run("b")  # another checkpoint replays all files
    assert table() == want
    kept = [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("list=")]
    assert len(kept) <= 2


def test_rows_after_the_watermark_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, "k int, t string").select("k", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: streams.debounced(streams.watch(spark, source, "k int, ts timestamp", 1), "k", "ts", "1 minute", "10 minutes")
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    put([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:30")])
    streams.run_now(stream(), out, at)
    put([(2, "2024-01-01 05:00:00")])
    streams.run_now(stream(), out, at)
    put([(1, "2024-01-01 00:01:00"), (2, "2024-01-01 09:00:00")])  # the first is later than the watermark lets through
    got = streams.run_now(stream(), out, at).where("k = 1").collect()
    assert [r["n"] for r in got] == [2]


def test_replays_end_with_the_flush(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(9)], "a int, p int")
    folder, schema = streams.replayed(rows, 3, F.col("p"), rows.limit(1))
    assert spark.read.schema(schema).parquet(folder).count() == 9 + 3 + 1
    with pytest.raises(Exception, match="."):
        spark.read.parquet(folder + "-none")


def _ticks(spark, rows):
    return spark.createDataFrame(rows, "k int, id long, t double").select("k", "id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"))


def test_last_hours_and_bursts(spark, tmp_path):
    """Rows that come late, twice and out of order give what they would in order; those beyond the watermark are dropped."""
    rng = random.Random(6)
    rows = [(i % 4, i, float(rng.randrange(0, 40000))) for i in range(160)]
    files = [rows[i::3] for i in range(3)] + [rows[:40]] + [[(9, 999, 10.0**7)]]
    for name, f in (("hours", lambda s: state.last_hours(s, "k", "id", "ts", 1.0, "2 days")), ("bursts", lambda s: state.bursts(s, "k", "id", "ts", 300, 2, "2 days"))):
        source = str(tmp_path / name)
        for part in files:
            _ticks(spark, part).coalesce(1).write.mode("append").parquet(source)
            time.sleep(0.05)
        found = streams.run_now(f(streams.watch(spark, source, "k int, id long, ts timestamp", 1)), f"{source}-out", f"{source}-at").where("k < 9").collect()
        if name == "hours":
            want = sorted((k, i, sum(a == k and t - 3600 <= s <= t for a, _, s in rows)) for k, i, t in rows)
            assert sorted((r["k"], r["id"], r["n"]) for r in found) == want
        else:
            want = []
            for k in range(4):
                times = sorted(t for a, _, t in rows if a == k)
                groups = [[times[0]]]
                for t in times[1:]:
                    groups[-1].append(t) if t - groups[-1][-1] <= 300 else groups.append([t])
                want += [(k, g[0], g[-1], len(g), "poll" if len(g) > 2 else "changes") for g in groups]
            assert sorted((r["k"], r["begin"].timestamp(), r["finish"].timestamp(), r["n"], r["action"]) for r in found) == sorted(want)


def test_decay_adds_up_in_any_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "PARTS", 2)
    rows = [(i % 3, i, float(86400 * (i % 7))) for i in range(30)] + [(1, 99, None)]
    source, target = str(tmp_path / "in"), str(tmp_path / "sums")
    for part in (rows[20:], rows[:5], rows[5:11], rows[11:12], rows[12:20]):
        _ticks(spark, part).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
    stream = streams.watch(spark, source, "k int, id long, ts timestamp", 1)
    streams.decayed_stream(stream, target, "k", "ts", "id", 2.0, str(tmp_path / "at"))
    as_of = "1970-01-12 00:00:00"
    want = {r["k"]: round(r["total"], 9) for r in streams.decayed(_ticks(spark, rows).where("ts is not null"), "k", "ts", "id", as_of, 2.0).collect()}
    assert {r["k"]: round(r["total"], 9) for r in streams.decayed_total(spark, target, "k", as_of, 2.0).collect()} == want
    assert len([p for p in os.listdir(target) if p.startswith("upto=")]) == 1


def test_a_stream_keeps_an_index(spark, tmp_path):
    """Late, repeated and removing changes in any order of files; a second stream over the same changes finds nothing to do."""
    now = dt.datetime(2024, 1, 1)
    row = lambda path, at, text: (path, now + dt.timedelta(seconds=at), text is None, len(text or ""), now + dt.timedelta(seconds=at), "python", hashlib.md5((text or "").encode()).hexdigest(), text)
    schema = "path string, at timestamp, deleted boolean, size long, modified timestamp, language string, content_hash string, text string"
    batches = [[row("a.py", 3, None), row("b.py", 2, "def b2(): pass")], [row("a.py", 1, "def a1(): pass"), row("b.py", 1, "def b1(): pass"), row("c.py", 1, "def c1(): pass"), row("c.py", 2, "def c2(): pass")], [row("b.py", 2, "def b2(): pass"), row("d.py", 5, "def b2(): pass")]]
    source = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
    store = Store.at(spark, str(tmp_path / "store"))
    run = lambda name: indexed.maintain(streams.watch(spark, source, schema, 1), store, "r", "/x", str(tmp_path / name), now, searchable=True)
    said = lambda: (sorted(r["path"] for r in store.read("files").collect()), sorted(r["name"] for r in store.read("symbols").collect()), sorted(r["term"] for r in indexing.text_indexes(store)[0].dictionary().collect() if r["term"][0] in "abcd" and r["term"] != "def"), store.read("repositories").first()["generation"])
    run("one")
    before = said()
    assert before[:2] == (["b.py", "c.py", "d.py"], ["b2", "c2"]) and {"b2", "c2"} <= set(before[2]) and "c1" not in before[2]
    run("two")
    assert said() == before
    with store.lease("r"), pytest.raises(Exception, match="Another writer"):
        spark.createDataFrame([row("e.py", 9, "x = 1")], schema).coalesce(1).write.mode("append").parquet(source)
        run("one")
    run("one")
    assert "e.py" in said()[0]
    here = store.read("files").select("path", "size", "modified", "language", "content_hash").withColumn("text", F.lit(""))
    assert indexed.refresh(store, "r", "/x", here, now)[0] == "fresh" and indexed.refresh(store, "r", "/x", here.withColumn("size", F.lit(1).cast("long")), now, off=True)[0] == "off"
