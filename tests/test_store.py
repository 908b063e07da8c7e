import datetime as dt
import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

from strata import cli
from strata.functions import edits
from strata.functions import text as T
from strata.operators import catalog, code, gateway, indexing, learnings, notes
from strata.operators import store as store_module
from strata.operators.store import MIGRATIONS, Store
from strata.sources import files

NOW = dt.datetime(2024, 3, 31, 12)


def test_store_versions(spark, tmp_path):
    store = Store.at(spark, f"parquet:{tmp_path}/store")
    assert [tuple(r) for r in store.versions().orderBy("version").collect()] == [(v, n) for v, n, _ in MIGRATIONS]
    assert store.next_id("notes") == 1
    row = spark.createDataFrame([(7, "r", "a note")], "id long, repo_id string, note string")
    before = store.append("notes", row)
    store.append("notes", row.withColumn("id", F.lit(8)))
    assert before.count() == 1 and store.read("notes").count() == 2 and store.next_id("notes") == 9
    assert Store.at(spark, f"{tmp_path}/store").read("notes").count() == 2  # migrating again keeps what is there
    store._write("_schema", spark.createDataFrame([(99, "later")], "version int, name string"))
    with pytest.raises(ValueError, match="99"):
        Store.at(spark, f"{tmp_path}/store")


def test_index_runs_follow_a_folder(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    put = lambda name, body: (root / name).write_bytes(body.encode())
    put("src/a.py", "def one():\n    return 1\n")
    put("src/copy.py", "def one():\n    return 1\n")
    put("b.md", "\ufeff# Title")
    store = Store.at(spark, str(tmp_path / "store"))
    run = lambda **k: {c: v for c, v in indexing.index_run(store, "r", str(root), files.scan(spark, str(root)), NOW, **k).first().asDict().items()}
    first = run()
    assert (first["added"], first["reused"], first["file_count"], first["generation"]) == (3, 1, 3, 1)
    assert [r["name"] for r in store.read("symbols").collect()] == ["one"]
    assert store.read("chunks").where("text like '# Title%'").count() == 1  # without its byte order mark
    assert run()["unchanged"] == 3
    put("src/a.py", "def two():\n    return 22\n")
    (root / "b.md").unlink()
    third = run()
    assert (third["updated"], third["removed"], third["unchanged"], third["generation"]) == (1, 1, 1, 3)
    assert {r["name"] for r in store.read("symbols").collect()} == {"one", "two"} and store.read("contents").count() == 2
    assert indexing.list_repositories(store).select("name", "file_count", "symbol_count").first() == ("repo", 2, 2)
    stale = indexing.freshness(store.read("files"), files.scan(spark, str(root))).first()
    assert not stale["stale"] and stale["mode"] == "scan"
    assert indexing.freshness(store.read("files"), files.scan(spark, str(root)), scan_most=1).first()["stale"] is None
    gone = files.scan(spark, str(root)).limit(0)
    assert indexing.freshness(store.read("files"), gone, spark.createDataFrame([("src/a.py",)], "path string")).first()["paths"] == ["src/a.py"]
    indexing.forget_repository(store, "r")
    assert store.read("files").isEmpty() and store.read("symbols").isEmpty()
    assert [indexing.refresh_policy(*x) for x in ((False, 9999), (True, 200), (True, 201))] == ["inline", "inline", "background"]


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_one_change_writes_little(spark, tmp_path):
    """What a run writes for one changed file does not grow with the store; a batch that is given again changes nothing."""
    schema = "path string, size long, modified timestamp, language string, content_hash string, text string"

    def snapshot(n, changed=()):
        texts = [f"class A{i}:\n    def run{i}(self):\n        return {'9' if i in changed else i}\n" for i in range(n)]
        return spark.createDataFrame([(f"s/{i}.py", len(t), NOW + dt.timedelta(seconds=int(i in changed)), "python", hashlib.md5(t.encode()).hexdigest(), t) for i, t in enumerate(texts)], schema)

    written = {}
    for n in (20, 400):
        root = tmp_path / str(n)
        store = Store.at(spark, str(root))
        indexing.index_run(store, "r", "/x", snapshot(n), NOW, searchable=True, batch=("s", 0))
        before = _bytes(root)
        run = indexing.index_run(store, "r", "/x", snapshot(n, (3,)), NOW, only_paths=["s/3.py"], searchable=True, batch=("s", 1)).first()
        written[n] = _bytes(root) - before
        assert (run["updated"], run["file_count"], store.read("symbols").count()) == (1, n, 2 * n)
        assert indexing.index_run(store, "r", "/x", snapshot(n, (3, 4)), NOW, searchable=True, batch=("s", 1)).count() == 0
        symbols, _ = indexing.text_indexes(store)
        assert symbols.totals()[0] == 2 * n and symbols.bm25("run3", prefix_last=False).count() == 1
    assert written[400] < 1.3 * written[20]


def test_content_that_comes_back(spark, tmp_path):
    store = Store.at(spark, str(tmp_path))
    row = lambda t: spark.createDataFrame([("a.py", len(t), NOW, "python", hashlib.md5(t.encode()).hexdigest(), t)] if t else [], "path string, size long, modified timestamp, language string, content_hash string, text string")
    for text in ("def a(): pass", None, "def a(): pass", "def bb(): pass", "def a(): pass"):
        indexing.index_run(store, "r", "/x", row(text), NOW, searchable=True)
        assert store.read("symbols").count() == store.read("contents").count() == store.read("files").count() == (1 if text else 0)
        assert indexing.text_indexes(store)[0].totals()[0] == (1 if text else 0)
    log = store._read("files", store._stored("files")).count()
    assert log == 5
    store_module.SLACK, kept = 0, store_module.SLACK
    try:
        store.put("files", store.read("files"), None, store.next_seq())
        assert store._read("files", store._stored("files")).count() == 1 == store.read("files").count()
    finally:
        store_module.SLACK = kept


def test_notes(spark):
    have = spark.createDataFrame([("r", "a/x.py", "h1"), ("r", "b.py", "h2")], "repo_id string, path string, content_hash string")
    inputs = spark.createDataFrame([(1, "r", "OrderService is the door, password=hunter22", ["\\a\\x.py", "gone.py"], [" CI ", "ci", ""]), (2, "r", "other", [], [])], "seq int, repo_id string, note string, files array<string>, tags array<string>")
    rows = notes.remember(inputs, have, NOW, 5)
    a, b = rows.orderBy("id").collect()
    assert (a["id"], a["note"], a["files"], a["file_hashes"], a["tags"]) == (5, "OrderService is the door, password=[REDACTED]", ["a/x.py", "gone.py"], ["h1", ""], ["ci"])
    assert "order service" in a["tokens"] and a["tokens"].endswith("x gone") and b["file_hashes"] == []
    moved = have.withColumn("content_hash", F.concat("content_hash", F.lit("!")))
    got = notes.recall(rows, moved, "r", "service").collect()
    assert [(r["id"], r["changed_files"], r["possibly_stale"]) for r in got] == [(5, ["a/x.py", "gone.py"], True)]
    again = notes.repin(rows, moved, [5], NOW)
    assert notes.recall(again, moved, "r", "service").first()["changed_files"] == ["gone.py"]
    assert notes.recall(rows, have, "r", None, "CI").count() == 1 and notes.recall(notes.forget(rows, "r", 5), have, "r").count() == 1


def test_since():
    assert T.since("1M", NOW) == dt.datetime(2024, 2, 29, 12) and T.since("24h", NOW) == dt.datetime(2024, 3, 30, 12) and T.since("2w", NOW) == dt.datetime(2024, 3, 17, 12)
    assert T.since(None, NOW) is T.since("  ", NOW) is None and T.since("2024-01-05", NOW) == dt.datetime(2024, 1, 5)
    assert T.since("2024-01-05T10:00:00+02:00", NOW) == dt.datetime(2024, 1, 5, 8)
    for bad in ("7x", "soon", "-3d"):
        with pytest.raises(ValueError, match="duration"):
            T.since(bad, NOW)


def test_filters_and_statuses_are_checked(spark):
    rows = spark.createDataFrame([], Store(spark, "").schemas["learnings"])
    with pytest.raises(ValueError, match="worked"):
        learnings.filtered(rows, outcome="maybe")
    with pytest.raises(ValueError, match="draft"):
        learnings.list_proposals(spark.createDataFrame([], Store(spark, "").schemas["proposals"]), "done")


def test_databases(spark, tmp_path, monkeypatch):
    spark.range(3).withColumnRenamed("id", "k").write.parquet(f"{tmp_path}/t.parquet")
    url = f"derby:{tmp_path}/d;create=true"
    spark.range(4).withColumnRenamed("id", "K").write.format("jdbc").option("url", f"jdbc:{url}").option("dbtable", "NUMBERS").save()
    monkeypatch.setenv("STRATA_DATABASES", f"files=parquet:{tmp_path};sql=jdbc:{url}?NUMBERS\nlost=postgres://u:secret@nowhere/db")
    found = catalog.Registry.from_environment()
    rows = {r["alias"]: r for r in found.listing(spark).collect()}
    assert rows["files"]["reachable"] and rows["sql"]["reachable"] and not rows["lost"]["reachable"] and rows["lost"]["error"]
    assert "secret" not in rows["lost"]["connection"]
    assert [tuple(r) for r in catalog.list_tables(spark, found.get("FILES")).collect()] == [(None, "t", "table", 3)]
    assert [r["column"] for r in catalog.describe(spark, found.get("sql"), "NUMBERS").collect()] == ["K"]
    found.get("sql").register(spark)
    assert catalog.read_query(spark, "select count(*) as n from NUMBERS").first()["n"] == 4
    broken = catalog.Database("x", "parquet", "", lambda s: [(None, "none", "table"), (None, "t", "table")], found.get("files").load)
    kept = {r["table"]: (r["columns"], r["error"] is None) for r in catalog.overview(spark, broken, {"t": (("k",), {})}).collect()}
    assert kept == {"none": (None, False), "t": (["k bigint PK"], True)}
    for bad in ("files=parquet:/x", "a=oracle:x"):
        with pytest.raises(ValueError, match="Alias|Unknown"):
            found.add_spec(bad)
    with pytest.raises(KeyError):
        found.get()


def test_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.png").write_bytes(b"\x89PNG")
    (tmp_path / "a.txt").write_bytes(b"12345")
    rows = files.list_directory(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r["name"], r["kind"], r["size"]) for r in rows] == [("in", "dir", None), ("a.txt", "file", 5)]
    assert files.folder_totals(files.list_directory(spark, str(tmp_path), "size")).first() == (1, 1, 5)
    info = files.file_info(spark, f"{tmp_path}/in/b.png").first()
    assert (info["kind"], info["size"], info["media_type"]) == ("file", 4, "image/png")
    with pytest.raises(FileNotFoundError):
        files.file_info(spark, f"{tmp_path}/none")
    assert files.read_media(spark, f"{tmp_path}/in/b.png").first()["data"] == "iVBORw=="
    assert files.read_media(spark, f"{tmp_path}/in/b.png", 3).first()["error"] == "too large"
    guard = files.Guard([str(tmp_path / "in")])
    (tmp_path / "in" / "out").symlink_to(tmp_path)
    assert guard.resolve("b.png").endswith("/in/b.png") and guard.listing(spark).count() == 1
    for bad in ("../a.txt", "out/a.txt", "/etc/passwd"):
        with pytest.raises(PermissionError):
            guard.resolve(bad)
    for folders in ([], [str(tmp_path / "none")]):
        with pytest.raises(ValueError, match="folder"):
            files.Guard(folders)


def test_git(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / ".gitignore").write_text("skip.py\n")
    for n in ("a.py", "b.py", "skip.py"):
        (tmp_path / n).write_text(f"x = '{n}'\n" * 9)
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "new file.py").write_text("y")
    git("mv", "a.py", "c.py")
    names = lambda df: sorted(r["path"] for r in df.collect())
    assert names(files.git_changes(spark, str(tmp_path))) == ["a.py", "c.py", "new file.py"]
    assert "skip.py" not in names(files.scan_repository(spark, str(tmp_path))) and "c.py" in names(files.git_files(spark, str(tmp_path)))
    assert files.git_log(spark, str(tmp_path)).first()["files"] == [".gitignore", "a.py", "b.py"] and len(files.git_head(str(tmp_path))) == 40


def test_project_files(spark, tmp_path):
    (tmp_path / "a.csproj").write_text('<Project><PackageReference Include="One" Version="1.2" /><PackageReference Include="Two"><Version> 3.0 </Version></PackageReference><PackageReference Include="Three" /></Project>')
    assert {(r["package"], r["version"]) for r in files.packages(spark, str(tmp_path / "a.csproj")).collect()} == {("One", "1.2"), ("Two", "3.0"), ("Three", None)}
    (tmp_path / "r.json").write_text('{"servers": [{"id": "a", "title": "A", "baseUrl": "https://x"}, {"id": "a", "baseUrl": "ftp://y"}, {"id": "b", "baseUrl": "http://z", "maxChars": 0}]}')
    with pytest.raises(ValueError, match="unique") as e:
        files.registry(spark, str(tmp_path / "r.json"))
    assert "no address" in str(e.value) and "range" in str(e.value)
    (tmp_path / "t.trx").write_text('<R><UnitTestResult testName="x" outcome="Passed" duration="00:00:01.5"/><UnitTestResult testName="y" outcome="Failed" duration="00:01:00"/></R>')
    assert files.report_totals(files.test_reports(spark, str(tmp_path / "t.trx"))).first() == (2, 1, 1, 0, 61.5)


def test_code_without_braces_or_ends(spark):
    text = "export type A = string\nexport const f = (x) => {\n  return x;\n};\nexport let z"
    rows = code.symbols(spark.createDataFrame([("a.ts", "typescript", text)], "path string, language string, text string")).orderBy("start_line").collect()
    assert [(r["name"], r["kind"], r["start_line"], r["end_line"]) for r in rows] == [("A", "type", 1, 4), ("f", "constant", 2, 4), ("z", "constant", 5, 5)]
    more = [("a.rs", "rust", "pub(crate) unsafe fn go<T>() {\n}\nstatic mut N: u8 = 1;\nimpl Thing {\n}"), ("b.kt", "kotlin", "data class P(val a: Int)\nprivate suspend fun P.run() {\n}"), ("c.java", "java", "public abstract class Q {\n}\nrecord R(int a) {}")]
    found = code.symbols(spark.createDataFrame(more, "path string, language string, text string"))
    assert {(r["path"], r["name"], r["kind"]) for r in found.collect()} == {("a.rs", "go", "function"), ("a.rs", "N", "constant"), ("a.rs", "Thing", "impl"), ("b.kt", "P", "class"), ("b.kt", "run", "function"), ("c.java", "Q", "class"), ("c.java", "R", "record")}


def test_resolution(spark):
    rows = spark.createDataFrame([("N.A.Run",), ("N.B.Run",), ("N.A",)], "full_name string")
    assert code.resolve(rows, "N.A") == "N.A" and code.resolve(rows, "a.run") == "N.A.Run"
    with pytest.raises(LookupError, match="ambiguous"):
        code.resolve(rows, "Run")
    with pytest.raises(LookupError, match="no"):
        code.resolve(rows, "Walk")


def test_edits_and_diffs(spark):
    df = spark.createDataFrame([("a  b\nc",), ("x",)], "t string")
    assert [r[0] for r in df.select(edits.apply_edits(F.col("t"), [("a b", "A"), ("c", "C")])).collect()] == ["A\nC", None]
    assert edits.unified("1\n2\n3", "1\n2\n3") == ""
    assert edits.unified("1\n2\n3", "1\nx\n3", "f", 0) == "--- a/f\n+++ b/f\n@@ -2 +2 @@\n-2\n+x"
    with pytest.raises(ValueError, match="replace"):
        edits.apply_edits(F.col("t"), [(" ", "x")])


def test_gateway(spark):
    tools = spark.createDataFrame([("s", "t", "{}")], "server string, tool string, schema string")
    assert gateway.tool_schema(tools, "s", "t") == "{}" and gateway.refuse_addresses({"a": "httpx", "b": 1}) == {"a": "httpx", "b": 1}
    with pytest.raises(LookupError):
        gateway.tool_schema(tools, "s", "u")
    with pytest.raises(ValueError, match="Addresses"):
        gateway.refuse_addresses({"a": " HTTPS://x"})
    assert catalog.server_info(spark).first()["engine"] == "spark"


def test_commands(spark, tmp_path):
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "a.py").write_text("def one():\n    pass\n")
    store = Store.at(spark, str(tmp_path / "store"))
    run = lambda c: cli.run(spark, c, str(tmp_path / "repo"), store, now=NOW).first()
    assert run("status")["stale"] and run("index")["added"] == 1 and not run("status")["stale"]
    assert run("verify")["healthy"] and run("rebuild")["generation"] == 2 and run("stats")["total"] == 0
    repo = store.read("repositories").first()["repo_id"]
    with store.lease(repo) as first, store.lease(repo) as second:
        assert first and not second
        assert run("index")["skipped"]
    assert run("index")["unchanged"] == 1


def test_lease_of_a_dead_writer(spark, tmp_path):
    store = Store.at(spark, str(tmp_path / "store"))
    with store.lease("r", 0.8) as held:
        time.sleep(1.5)  # it is written anew while it is held
        with store.lease("r", 0.8) as other:
            assert held and not other
    assert store._create(f"{store.root}/_locks/r", "dead")
    with store.lease("r", 60) as held:
        assert not held
    time.sleep(1.2)
    with store.lease("r", 1.0) as held:
        assert held and store._owner(f"{store.root}/_locks/r") != "dead"
    assert store._owner(f"{store.root}/_locks/r") is None
