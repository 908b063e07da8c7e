"""A store of tables as folders of Parquet files, with a fixed schema that migrations make, and leases for its one writer."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

#: Versions of the schema, in order: the tables that each adds, or the columns that it adds to a table.
MIGRATIONS: tuple[tuple[int, str, dict[str, str]], ...] = (
    (1, "index", {
        "repositories": "repo_id string, root string, name string, created_at timestamp, last_indexed_at timestamp, head_sha string, generation int, file_count long, symbol_count long, chunk_count long, last_error string",
        "files": "repo_id string, path string, content_hash string, size long, modified timestamp, language string, generation int, indexed_at timestamp",
        "contents": "content_hash string, language string, line_count int, symbol_count int, chunk_count int, first_seen_at timestamp",
        "symbols": "content_hash string, name string, full_name string, kind string, container string, signature string, doc string, start_line int, end_line int, tokens string",
        "chunks": "content_hash string, ordinal int, start_line int, end_line int, heading string, text string, tokens string",
        "embeddings": "content_hash string, ordinal int, model string, vector array<float>",
        "notes": "id long, repo_id string, note string, files array<string>, file_hashes array<string>, tags array<string>, tokens string, useful_count long, created_at timestamp, updated_at timestamp",
        "search_feedback": "id long, repo_id string, query_tokens string, target string, created_at timestamp",
        "queries": "query_id string, repo_id string, query_tokens string, hits array<struct<id:string,path:string>>, at timestamp",
    }),
    (2, "learnings", {
        "learnings": "id long, fingerprint string, outcome string, category string, title string, detail string, tags array<string>, repo string, files array<string>, tool string, provider string, model string, evidence string, source string, occurrences long, useful long, tokens string, created_at timestamp, last_seen timestamp",
        "tool_feedback": "id long, tool string, worked boolean, note string, repo string, provider string, created_at timestamp",
        "proposals": "id long, status string, target_repo string, title string, rationale string, learning_ids array<long>, likely_files array<string>, acceptance_criteria array<string>, prompt string, corroborations long, dispatch_mode string, external_id string, pr_url string, last_error string, created_at timestamp, updated_at timestamp",
        "dispatches": "id long, proposal_id long, mode string, request_id string, external_id string, status string, detail string, created_at timestamp",
    }),
    (3, "batches", {
        "repositories": "repo_id string, root string, name string, created_at timestamp, last_indexed_at timestamp, head_sha string, generation int, file_count long, symbol_count long, chunk_count long, last_error string, last_stream string, last_batch long",
        "changes": "repo_id string, path string, at timestamp",
    }),
)

#: Tables that are logs: of the rows of a key the last one counts, unless it says that the key is gone.
LOGGED = {"files": ("repo_id", "path"), "contents": ("content_hash",), "changes": ("repo_id", "path")}
#: Tables whose rows live as long as the content that was put with them.
DEPENDENT = ("symbols", "chunks")
#: A log is rewritten when it has more than twice its live rows, and this many more.
SLACK = 10_000
_LOG = "_seq long, _gone boolean"


class Store:
    """Tables below a folder that driver and executors share.

    append() and put() only add files, so what a change costs depends on the change. write() makes a whole new version of a
    table; the version before stays for readers that have begun, and goes with the next one. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas: dict[str, str] = {}
        for _, _, made in MIGRATIONS:
            self.schemas |= made

    @classmethod
    def at(cls, spark: SparkSession, spec: str | None = None) -> Store:
        """The store that ``spec`` names: parquet:folder, a folder, or the session's shared folder."""
        where = re.sub("^parquet:", "", spec or "") or f"{tables.work_folder(spark)}/store"
        return cls(spark, str(Path(where).expanduser()) if where.startswith("~") else where).migrate()

    def migrate(self) -> Store:
        """Apply the migrations that the ledger does not list, in order; a ledger of a newer library is an error."""
        done = {r["version"] for r in self._read("_schema", "version int, name string").collect()} if self._latest("_schema") is not None else set()
        if newer := done - {v for v, _, _ in MIGRATIONS}:
            raise ValueError(f"The store has schema version {max(newer)}, which this library does not know.")
        for version, name, made in MIGRATIONS:
            if version not in done:
                for table in made:  # columns that a table does not have yet are read as null
                    if self._latest(table) is None:
                        self._write(table, self.spark.createDataFrame([], self._stored(table)))
                done.add(version)
                rows = [(v, n) for v, n, _ in MIGRATIONS if v in done]
                self._write("_schema", self.spark.createDataFrame(rows, "version int, name string"))
        return self

    def versions(self) -> DataFrame:
        """(version, name) of the migrations that were applied."""
        return self._read("_schema", "version int, name string")

    def read(self, table: str) -> DataFrame:
        """The table as it is now; later writes do not change what this reads."""
        return self._living(table).select(*self._columns(table))

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Replace a table; returns it. Rows may come from the table itself."""
        self._write(table, self._shaped(table, rows))
        return self.read(table)

    def append(self, table: str, rows: DataFrame, seq: int = 0) -> DataFrame:
        """Add rows to a table, of a log or of contents under the number of a change; returns it."""
        return self._add(table, self._shaped(table, rows, seq))

    def put(self, table: str, rows: DataFrame, gone: DataFrame | None, seq: int) -> DataFrame:
        """Add rows to a log under a number that is higher than all before: they replace rows of their keys, and the keys of ``gone`` go."""
        new = self._shaped(table, rows, seq)
        if gone is not None:
            new = new.unionByName(self._shaped(table, gone.select(*LOGGED[table]), seq, True))
        self._add(table, new)
        log = self._read(table, self._stored(table))
        live = self._living(table)
        if log.count() > 2 * live.count() + SLACK:
            self._write(table, live)
        return self.read(table)

    def next_seq(self) -> int:
        """A number for the next change: higher than any in the logs."""
        return max(self._read(t, self._stored(t)).agg(F.coalesce(F.max("_seq"), F.lit(0))).first()[0] for t in LOGGED) + 1

    def _columns(self, table: str) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], self.schemas[table]).schema.fields]

    def _stored(self, table: str) -> str:
        return self.schemas[table] + (f", {_LOG}" if table in LOGGED else ", _seq long" if table in DEPENDENT else "")

    def _living(self, table: str) -> DataFrame:
        found = self._read(table, self._stored(table))
        if table in LOGGED:
            keys = LOGGED[table]
            last = found.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct("*"), F.coalesce("_seq", F.lit(0))).alias("r"))
            return last.select("r.*").where(~F.coalesce("_gone", F.lit(False)))
        if table == "embeddings":  # a content that comes back has the same vectors
            return found.join(self._living("contents").select("content_hash"), "content_hash", "left_semi")
        if table in DEPENDENT:  # a content that went and came back was put with rows of its own
            held = self._living("contents").select("content_hash", F.coalesce("_seq", F.lit(0)).alias("_held"))
            return found.join(held, (found["content_hash"] == held["content_hash"]) & (F.coalesce(found["_seq"], F.lit(0)) == held["_held"]), "left_semi")
        return found

    def _add(self, table: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("append").parquet(f"{self.root}/{table}/v={self._latest(table)}", compression="zstd")
        return self.read(table)

    def next_id(self, table: str) -> int:
        """One more than the largest id."""
        return (self.read(table).agg(F.max("id")).first()[0] or 0) + 1

    @contextmanager
    def lease(self, name: str, seconds: float = 120.0) -> Iterator[bool]:
        """Whether this process may write under a name. A lease is a file that is written anew while it is held; one that was not
        written for ``seconds`` is dead and is taken over: moving it away succeeds for one process only."""
        path, owner = f"{self.root}/_locks/{name}", uuid.uuid4().hex
        held = self._create(path, owner)
        if not held and self._age(path) > seconds:
            if self._move(path, f"{path}-{owner}"):
                tables.remove(self.spark, f"{path}-{owner}")
                held = self._create(path, owner)
        stop = threading.Event()

        def beat() -> None:
            while not stop.wait(seconds / 4):
                if self._owner(path) != owner:
                    return  # it was taken over
                self._create(path, owner, True)

        keeper = threading.Thread(target=beat, daemon=True)
        if held:
            keeper.start()
        try:
            yield held
        finally:
            stop.set()
            if held:
                keeper.join()
                if self._owner(path) == owner:
                    tables.remove(self.spark, path)

    def _file(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _create(self, path: str, owner: str, over: bool = False) -> bool:
        target, store = self._file(path)
        try:
            out = store.create(target, over)
        except Exception:  # whatever the file system raises for a file that exists
            if not store.exists(target):
                raise
            return False
        out.writeBytes(owner)
        out.close()
        return True

    def _move(self, path: str, to: str) -> bool:
        target, store = self._file(path)
        try:
            return bool(store.rename(target, self._file(to)[0]))
        except Exception:  # another process was first
            return False

    def _owner(self, path: str) -> str | None:
        target, store = self._file(path)
        if not store.exists(target):
            return None
        stream = store.open(target)
        try:
            return bytes(stream.readNBytes(64)).decode()
        finally:
            stream.close()

    def _age(self, path: str) -> float:
        target, store = self._file(path)
        return time.time() - store.getFileStatus(target).getModificationTime() / 1000 if store.exists(target) else 0.0

    def _shaped(self, table: str, rows: DataFrame, seq: int = 0, gone: bool = False) -> DataFrame:
        fields = self.spark.createDataFrame([], self._stored(table)).schema.fields
        marks = [c for c in ("_seq", "_gone") if c in {f.name for f in fields}]
        rows = rows.drop(*marks).withColumns({c: F.lit(seq if c == "_seq" else gone) for c in marks})
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def _latest(self, table: str) -> int | None:
        found = [int(n[2:]) for n, is_folder, *_ in tables.listing(self.spark, f"{self.root}/{table}") if is_folder and n.startswith("v=")]
        return max((v for v in found if tables.exists(self.spark, f"{self.root}/{table}/v={v}/_SUCCESS")), default=None)

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/v={self._latest(table)}")

    def _write(self, table: str, rows: DataFrame) -> None:
        now = self._latest(table)
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/v={0 if now is None else now + 1}")
        if now:
            tables.remove(self.spark, f"{self.root}/{table}/v={now - 1}")
