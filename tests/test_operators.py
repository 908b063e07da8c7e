import random

import pytest
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.functions import vectors as V
from strata.functions.stem import stem, stems
from strata.operators import catalog, graph, guard, indexing, learnings, search
from strata.sources import files


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("token", "words"), [("closeLedgerBook", "closeLedgerBook close ledger book"), ("tax_rate", "tax_rate tax rate"), ("XYZGraph7", "XYZGraph7 xyz graph 7"), ("harbour", "harbour"), (None, "")])
def test_identifiers(spark, token, words):
    assert one(spark, token, T.split_identifiers) == words


def test_terms(spark):
    assert one(spark, "Where is the Order service?", T.terms) == ["order", "service"]
    assert one(spark, "where is the", T.terms) == ["where", "is", "the"] and T.query_terms("where is the") == ["where", "is", "the"]
    assert one(spark, None, T.terms) == [] and T.query_terms("") == []


#: For each of SECRET_SHAPES, what stands before a secret, its alphabet, the least length that counts, and what stands after it.
_LETTERS, _CAPITALS = "abcdefghijkmnpqrstuvwxyz", "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"
SHAPED = (
    ("-----BEGIN PRIVATE KEY-----\n", _LETTERS, 1, "\n-----END PRIVATE KEY-----"), ("queue://worker:", _LETTERS, 1, "@host/x"), ("the Bearer ", _LETTERS, 16, ""), ("eyJabcdefgh.", _LETTERS, 8, ".ijklmnopq"),
    ("sk-", _LETTERS, 20, ""), ("ghs_", _LETTERS, 20, ""), ("AKIA", _CAPITALS, 16, " is"), ("my_token = '", _LETTERS, 6, "'"),
)
#: Of these a shorter secret does not count.
_LEAST = 2


def _credentials():
    """(text, secret, whether it counts) made by rule: for each shape, secrets of the least length and longer, and near misses."""
    rng = random.Random(11)
    for before, letters, least, after in SHAPED:
        for more in (0, 1, 7):
            secret = "".join(rng.choices(letters, k=least + more))
            counts = letters is not _CAPITALS or not more  # an access key has a length of its own
            yield f"x {before}{secret}{after}", before + secret, counts
        if least >= _LEAST:
            short = "".join(rng.choices(letters, k=least - 1))
            yield f"x {before}{short}{after}", before + short, False


def test_redaction(spark):
    assert len(SHAPED) == len(T.SECRET_SHAPES)
    rows = spark.createDataFrame(list(_credentials()), "t string, secret string, counts boolean")
    for r in rows.select("t", "secret", "counts", T.redact(F.col("t")).alias("out"), T.contains_secret(F.col("t")).alias("hit")).collect():
        assert r["hit"] == r["counts"], r["t"]
        assert (r["secret"] not in r["out"] and T.REDACTED in r["out"]) if r["counts"] else r["out"] == r["t"]
    assert one(spark, None, T.redact) is None
    assert one(spark, "set pwd=opensesame; go", T.redact) == "set pwd=[REDACTED]; go"
    assert one(spark, "ftp://me:opensesame@host/dir", T.redact) == "ftp://me:[REDACTED]@host/dir"
    assert one(spark, "Data Source=x;Password=a b;User=c", T.redact_connection) == "Data Source=x;Password=***;User=c"


@pytest.mark.parametrize(("value", "repo"), [("https://github.com/Owner/Name.git", "owner/name"), ("git@github.com:Owner/Name", "owner/name"), ("Owner/Name", "owner/name"), ("/home/me/Clone/", "clone"), ("C:\\work\\Repo", "repo"), ("  ", None)])
def test_repositories(spark, value, repo):
    assert one(spark, value, T.normalize_repo) == repo


def test_fusion_order(spark):
    lists = [("a", 0, 1, "b"), ("a", 0, 2, "a"), ("a", 0, 3, "d"), ("b", 1, 1, "b"), ("b", 1, 2, "a"), ("b", 1, 3, "c")]
    rows = spark.createDataFrame(lists, "ranking string, ranking_no int, rank int, key string").withColumn("weight", F.lit(1.0))
    got = search.fuse(rows).orderBy(F.desc("score"), "seen").collect()
    assert [r["key"] for r in got] == ["b", "a", "d", "c"] and got[0]["ranks"] == {"a": 1, "b": 1}
    assert got[0]["score"] == pytest.approx(2 / 61)
    twice = search.fuse(rows.unionByName(rows.where("key = 'c'").withColumn("rank", F.lit(9)))).where("key = 'c'").first()
    assert twice["score"] == pytest.approx(1 / 63 + 1 / 69) and twice["ranks"] == {"b": 3}
    mirrored = rows.withColumn("ranking_no", 1 - F.col("ranking_no"))
    assert {r["key"]: r["score"] for r in search.fuse(mirrored).collect()} == {r["key"]: r["score"] for r in got}


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([3.0, 4.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([], [])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in rows.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0, 1, 0, 0, 0, 0]
    assert one(spark, [3.0, 4.0], V.normalize, "array<float>") == pytest.approx([0.6, 0.8])


def test_chunks(spark):
    text = "\n".join(f"line {i}" for i in range(1, 201))
    rows = indexing.window_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "\n" * 100 + "x")], "id int, text string"), "id").collect()
    mine = [(r["start_line"], r["end_line"]) for r in rows if r["id"] == 1]
    assert mine == [(1, 80), (71, 150), (141, 200)] and {r["id"] for r in rows} == {1, 4}
    assert [r["ordinal"] for r in rows if r["id"] == 4] == [0]


def test_ignore_rules_and_languages(spark):
    paths = {"lib/core.g.cs": True, "lib/kept.g.cs": False, "notes/todo.md": True, "more/notes/todo.md": False, "gen/x.py": True, "a/vendor/x.py": True, "a/b.tar": True, "app/.env.local": True, "app/env.py": False}
    rules = ("# a comment", "", "gen/", "*.g.cs", "!kept.g.cs", "/notes/todo.md")
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", files.ignored(F.col("path"), rules).alias("out"))
    assert {r["path"]: r["out"] for r in rows.collect()} == paths
    for path, lang in [("src/A.cs", "csharp"), ("web/app.tsx", "typescript"), ("README.md", "markdown"), ("Dockerfile", "dockerfile"), ("build/x.csproj", "msbuild"), ("unknown.zzz", "text")]:
        assert one(spark, path, files.language) == lang
    assert one(spark, bytearray(b"MZ\0\1"), files.is_binary, "binary") and not one(spark, bytearray(b"hello"), files.is_binary, "binary")


def test_file_scan(spark, tmp_path):
    for name, body in {"src/a.py": b"class A:\n    pass\n", "b.md": b"# T", "x.png": b"1", "bin/y.cs": b"2", "nul.txt": b"a\0b", ".env": b"k"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = files.scan(spark, str(tmp_path)).collect()
    assert {(r["path"], r["language"]) for r in rows} == {("src/a.py", "python"), ("b.md", "markdown")}
    found = files.requested(files.scan(spark, str(tmp_path)), ["b.md", "none"]).collect()
    assert {r["path"]: r["error"] for r in found} == {"b.md": None, "none": "not found"}


def test_recording_twice_counts_twice(spark):
    rows = [(1, "Use X!", "short", ["a"], None), (2, "use x", "longer text", ["b", "a"], "p"), (3, "USE X", "longer tex2", ["c"], None)]
    df = spark.createDataFrame(rows, "seq int, title string, detail string, tags array<string>, provider string").withColumn("seen_at", F.col("seq"))
    df = df.withColumn("fingerprint", learnings.fingerprint(F.lit("worked"), F.col("title"), F.lit(None), F.lit(None).cast("array<string>"), F.lit("T")))
    (r,) = learnings.merge_records(df).collect()
    assert (r["occurrences"], r["title"], r["detail"], r["tags"], r["provider"], r["last_seen"]) == (3, "Use X!", "longer text", ["a", "b", "c"], "p", 3)


def test_log_round_trip(spark):
    schema = "id int, outcome string, category string, title string, detail string, tags array<string>, repo string, files array<string>, tool string, provider string, evidence string, occurrences long, d string"
    rows = [(1, "failed", "ci", "Pin it", "two\nlines", ["a", "b"], "o/r", [], None, "acme", "", 3, "2026-01-05 00:00:00"), (2, "worked", "squad", "t", "## 2026-01-06 — /build\n\n- Result: pass\n", [], None, [], None, None, None, 1, "2026-01-06 00:00:00")]
    df = spark.createDataFrame(rows, schema).withColumn("last_seen", F.to_timestamp("d"))
    entries = [r["text"] for r in learnings.export_log(df).orderBy("place").collect()]
    log = learnings.appended(None, entries)
    assert log.startswith("# Learnings\n") and learnings.export_log(df, log).count() == 0
    assert learnings.appended(log, []) == log
    a, b = learnings.parse_log(spark.createDataFrame([(9, log.replace("\n", "\r\n"))], "id int, text string"), "id").orderBy("entry").collect()
    assert a[1:] == (0, "2026-01-05", "learning", "failed", "Pin it", "two lines", "ci", ["a", "b"], "o/r", [], None, "acme", None)
    assert (b["kind"], b["outcome"], b["title"], b["tags"]) == ("squad", "worked", "/squad pass (2026-01-06)", ["squad", "squad", "pass", "tier:inherit"])


def test_read_query(spark):
    spark.range(10).createOrReplaceTempView("ten")
    assert catalog.read_query(spark, "SELECT id FROM ten WHERE id > @n", {"n": 6}).count() == 3
    assert catalog.read_query(spark, "SELECT id FROM ten", most=4).count() == 4
    with pytest.raises(guard.GuardError):
        catalog.read_query(spark, "DROP VIEW ten")
    assert not files.capped(spark.range(3).toDF("id"), 3).first()["truncated"] and files.capped(spark.range(4).toDF("id"), 3).first()["truncated"]
    assert "Physical Plan" in catalog.explain_query(spark, "SELECT id FROM ten").first()[0]
    with pytest.raises(guard.GuardError):
        catalog.write_query(spark, "CREATE TABLE t (i int)")
    with pytest.raises(guard.GuardError):
        catalog.write_query(spark, "SELECT 1", read_only=False)
    got = catalog.query_result(spark, "SELECT id, CAST(id AS STRING) AS s, X'00FF' AS b, DATE'2024-02-01' AS d FROM ten ORDER BY id", most=2)
    assert got.rows == [(0, "0", "AP8=", "2024-02-01"), (1, "1", "AP8=", "2024-02-01")] and got.truncated and got.columns == ["id", "s", "b", "d"]
    assert not catalog.query_result(spark, "SELECT 1 AS x").truncated


def test_csv(spark):
    df = spark.createDataFrame([(1, "Ada", None, "a, b"), (2, "Bo", "x", 'say "hi"')], "id int, name string, email string, note string")
    assert [r["line"] for r in catalog.csv_lines(df, ["id"]).orderBy("line_no").collect()] == ["id,name,email,note", '1,Ada,,"a, b"', '2,Bo,x,"say ""hi"""']


def test_stems(spark):
    words = {"caresses": "caress", "ponies": "poni", "feed": "feed", "agreed": "agre", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "hopeful": "hope", "adoption": "adopt", "roll": "roll", "is": "is", "naïve": "naïve"}
    assert {w: stem(w) for w in words} == words
    rows = spark.createDataFrame([(w,) for w in [*words, None]], "w string").select("w", stems("w").alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == words | {None: None}


def test_index_search_equals_scan(spark, tmp_path):
    texts = ["Café opens, opening times", "the licence and the licensing", "nothing", None, "", "licence licence open", "opens"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    plain, stemmed = str(tmp_path / "plain"), str(tmp_path / "stemmed")
    search.write_index(docs, plain, "id", {"text": 1.0}, files=3)
    search.write_index(docs, stemmed, "id", {"text": 1.0}, stemmed=True)
    scores = lambda df: {r["id"]: round(r["score"], 9) for r in df.collect()}
    for q in ("licence", "the lic", "open", "", "absent"):
        assert scores(search.search_index(spark, plain, q, "id")) == scores(search.bm25(docs, q, "id", {"text": 1.0}))
    assert set(scores(search.search_index(spark, stemmed, "opened", "id", False))) == {0, 5, 6}
    assert set(scores(search.search_index(spark, stemmed, "cafe", "id", False))) == {0}


def test_graphs(spark):
    df = lambda *e: spark.createDataFrame(list(e), "src string, dst string")
    start = lambda n: spark.createDataFrame([(n,)], "node string")
    knot = df(*[(a, b) for a in "abc" for b in "abc" if a != b], ("c", "d"))
    assert {(r["node"], r["level"]) for r in graph.closure(knot, start("a")).collect()} == {("b", 1), ("c", 1), ("d", 2)}
    found = [r["nodes"] for r in graph.cycles(knot).collect()]
    assert found == [["a", "b"], ["a", "b", "c"], ["a", "c"], ["b", "c"]]
    assert graph.cycles(df(("a", "b"), ("b", "c"))).count() == 0 and len(graph.cycles(knot, most=2).collect()) == 2
    whole = df(*[(f"{a:02}", f"{b:02}") for a in range(9) for b in range(9)])
    assert graph.cycles(whole, 12, 10**6).count() == 2**9 - 1 - 9
    nodes, edges = graph.call_graph(knot, start("c"), 1)
    assert {(r["node"], r["direction"]) for r in nodes.collect()} == {("c", "start"), ("a", "out"), ("b", "out"), ("d", "out"), ("a", "in"), ("b", "in")}
    assert edges.count() == 7
    with pytest.raises(ValueError, match="in, out"):
        graph.call_graph(knot, start("c"), 1, "up")


def test_large_commits_never_meet(spark):
    rows = spark.createDataFrame([(1, i) for i in range(41)] + [(2, 0), (2, 1), (3, 5)], "c long, i long")
    assert [tuple(r) for r in indexing.cochange_pairs(rows, "c", "i").orderBy("a").collect()] == [(0, 1, 1, 1, 1.0), (1, 0, 1, 1, 1.0)]
