"""A test for each finding of the fourth round that was right: each failed, or took far too much, before."""

import os
import sys

import duckdb
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from oracle import agree, views
from strata.functions import text as T
from strata.operators import learnings
from strata.operators.store import Store
from strata.plans.queries import ORACLE_SQL, QUERIES
from strata.sources import tables

SMALL = "/root/testdata/sf0.001"


def test_rows_are_placed_by_file(spark, tmp_path):
    """Of dispatches of one time and number the first file's counts, wherever it stands there; SQL reads in order by one thread."""
    sf_dir = tmp_path / "a b%20c"
    (sf_dir / "lineitem.parquet").mkdir(parents=True)
    for n, flag in enumerate("RAA"):
        rows = f"SELECT (CASE WHEN {n} = 0 THEN 39 - i ELSE i END)::BIGINT AS l_orderkey, 1 AS l_linenumber, '{flag}' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '2020-01-01' AS l_shipdate FROM range(40) t(i)"
        duckdb.execute(f"COPY ({rows}) TO '{sf_dir}/lineitem.parquet/part-{n}.parquet' (FORMAT parquet)")
    duckdb.execute(f"COPY (SELECT i AS o_orderkey, 'P' AS o_orderstatus, TIMESTAMP '2020-01-01' AS o_orderdate FROM range(45) t(i)) TO '{sf_dir}/orders.parquet' (FORMAT parquet)")
    placed = tables.placed(tables.load(spark, str(sf_dir), "lineitem"), "seq").select("seq").collect()
    assert sorted(r[0] for r in placed) == [(n << 40) + i for n in range(3) for i in range(40)]
    con = views(sf_dir)
    con.execute("SET threads = 1")
    agree(QUERIES["dispatch_status"](spark, str(sf_dir)), con, ORACLE_SQL["dispatch_status"])


def test_dispatches_without_a_time_or_number(spark, tmp_path):
    """SQL puts null above all times and numbers."""
    times = ("NULL", "TIMESTAMP '2020-01-01'", "TIMESTAMP '2020-01-02'")
    rows = [(o, n, t) for o in range(40) for n in ("NULL", 1, 2) for t in times if o % 4 or t != "NULL"]
    values = ", ".join(f"({o}::BIGINT, {n}::INT, '{'R' if 'NULL' in (n, t) else 'A'}', 'O', {t})" for o, n, t in rows)
    duckdb.execute(f"COPY (SELECT * FROM (VALUES {values}) t(l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    duckdb.execute(f"COPY (SELECT i AS o_orderkey, 'P' AS o_orderstatus, TIMESTAMP '2020-01-01' AS o_orderdate FROM range(45) t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    agree(QUERIES["dispatch_status"](spark, str(tmp_path)), views(str(tmp_path)), ORACLE_SQL["dispatch_status"])


def test_entries_are_read_once(spark, monkeypatch, capsys):
    """Two imports of the same logs read and fold their entries once; an entry's fields are found by one pattern; tokens are made of the newest repeat only."""
    read, whole = [], learnings.parse_log
    monkeypatch.setattr(learnings, "parse_log", lambda *a, **k: read.append(a) or whole(*a, **k))
    agree(QUERIES["import_log"](spark, SMALL), views(SMALL), ORACLE_SQL["import_log"])
    assert len(read) == 1
    whole(spark.createDataFrame([(1, "")], "id long, text string"), "id").explain()
    assert capsys.readouterr().out.count("^-\\s+") == 1


def test_imports_of_repeats_and_odd_fields(spark):
    """Of fields of one name the first counts; imports of entries read once are those of logs read twice; logs without a key are in."""
    log = "# Log\n\n## 2024-01-02 — learning\n\n- title:\t Fix A \n- TITLE: other\n-  Detail: token=abcdefgh: x\n- Outcome: Worked\n- Tool: None\n\n## 2024-01-03 — /Build\n\n-\nResult: Pass\n- Provider: Acme1\n"
    texts = spark.createDataFrame([(1, log), (None, log), (2, "# Log\n"), (3, None)], "id long, text string")
    found = sorted(tuple(r) for r in learnings.parse_log(texts.where("id = 1"), "id").select("entry", "title", "detail", "outcome", "tool", "provider").collect())
    assert found[0] == (0, "Fix A", "token=abcdefgh: x", "worked", None, None) and found[1][1] == "/squad pass (2024-01-03)" and found[1][5] == "acme1"
    none = spark.createDataFrame([], Store(spark, "").schemas["learnings"])
    once = learnings.record_folded(none, learnings.log_records(texts, "id", "2024-01-31"))
    twice = learnings.import_log(once.drop("created"), texts, "id", "2024-01-31").select("id", "title", "detail", "occurrences", "tokens", "created").orderBy("id").collect()
    assert [(r["id"], r["title"], r["occurrences"], r["created"]) for r in twice] == [(1, "Fix A", 4, False), (2, "/squad pass (2024-01-03)", 4, False)]
    assert twice[0]["detail"] == "token=[REDACTED] x" and "acme1 acme 1" in twice[1]["tokens"]


def test_secrets_are_found_by_their_signs(spark):
    """redact_rare() is redact(), for every shape in any case."""
    made = ["-----BEGIN PRIVATE KEY-----x-----END PRIVATE KEY-----", "http://u:pass@h", "BEARER " + "z" * 20, "eyJ" + ".".join(["a" * 9] * 3), "sk-" + "a" * 22, *[f"gh{c}_" + "b" * 24 for c in "pousr"], "AKIA" + "A" * 16, "ASIA" + "B" * 16]
    made += [f"{n} = hunter22x" for n in ("Password", "PASSWD", "my_pwd", "secret", "apikey", "API_KEY", "accesskey", "Access_Key", "Token")]
    rows = spark.createDataFrame([(t,) for t in [*made, "nothing here", "", None]], "t string").select("t", T.redact(F.col("t")).alias("a"), T.redact_rare(F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and sum(r["a"] != r["t"] for r in rows) == len(made)
