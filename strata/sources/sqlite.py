"""SQLite files as a data source that reads ranges of row ids in parallel and takes filters, and as a sink of one file a partition."""

from __future__ import annotations

import glob
import os
import re
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from . import tables

#: Rows of an Arrow batch, and partitions of a file by default.
BATCH, PARTITIONS = 8192, 8
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _local(path: str) -> str:
    return re.sub(r"^file:(?://(?=/))?", "", path)


def _files(path: str) -> list[str]:
    """A file, or all of a folder, in order."""
    path = _local(path)
    return sorted(glob.glob(f"{glob.escape(path)}/*.sqlite")) if os.path.isdir(path) else [path]


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type(declared: str) -> str:
    """A column's type by SQLite's rules of affinity."""
    up = declared.upper()
    return "bigint" if "INT" in up else "string" if any(x in up for x in ("CHAR", "CLOB", "TEXT")) else "binary" if "BLOB" in up or not up else "double"


def columns(path: str, table: str) -> list[tuple[str, str, bool, bool]]:
    """(name, type, nullable, primary key) of a table's columns."""
    with _open(_files(path)[0]) as con:
        return [(r[1], _type(r[2]), not r[3] and not r[5], bool(r[5])) for r in con.execute(f"PRAGMA table_info({_quoted(table)})")]


def keys(path: str) -> tables.Keys:
    """Primary and foreign keys of all tables, as the files declare them."""
    with _open(_files(path)[0]) as con:
        names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite%' ORDER BY name")]
        return {n: (tuple(c for c, _, _, pk in columns(path, n) if pk), {r[3]: (r[2], r[4]) for r in con.execute(f"PRAGMA foreign_key_list({_quoted(n)})")}) for n in names}


def indexes(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(index, unique, position, column) of a table's indexes."""
    with _open(_files(path)[0]) as con:
        listed = [(r[1], bool(r[2])) for r in con.execute(f"PRAGMA index_list({_quoted(table)})")]
        rows = [(n, unique, r[0] + 1, r[2]) for n, unique in listed for r in con.execute(f"PRAGMA index_info({_quoted(n)})")]
    return spark.createDataFrame(sorted(rows), "index string, unique boolean, position int, column string")


@dataclass
class Range(InputPartition):
    """Row ids from ``low`` to ``high`` of a file."""

    path: str
    low: int
    high: int


class SqliteSource(DataSource):
    """Format "sqlite": option path (a file, or a folder of them), table, and partitions for each file."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t, _, _ in columns(self.options["path"], self.options["table"]))

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], int(self.options.get("partitions", PARTITIONS)), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int, schema: StructType):
        self.path, self.table, self.parts, self.schema = path, table, parts, schema
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons, sets and nulls go to SQLite; the rest comes back and is Spark's."""
        text = {f.name for f in self.schema.fields if f.dataType.simpleString() == "string"}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name is None:
                yield f
            elif type(f) in _COMPARED and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                self.where.append((f"{_quoted(name)} {_COMPARED[type(f)]} ?", [f.value]))
            elif isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value):
                self.where.append((f"{_quoted(name)} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif isinstance(f, (IsNull, IsNotNull)):
                self.where.append((f"{_quoted(name)} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []))
            elif isinstance(f, StringStartsWith) and name in text:
                self.where.append((f"substr({_quoted(name)}, 1, ?) = ?", [len(f.value), f.value]))
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for path in _files(self.path):
            with _open(path) as con:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            if low is not None:
                step = max(1, -(-(high - low + 1) // self.parts))
                out += [Range(path, a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
        return out or [Range(_files(self.path)[0], 1, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema.fields]
        kinds = [_ARROW[f.dataType.simpleString()] for f in self.schema.fields]
        sql = f"SELECT {', '.join(map(_quoted, names))} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?" + "".join(f" AND {w}" for w, _ in self.where)
        with _open(partition.path) as con:
            found = con.execute(sql, [partition.low, partition.high, *[v for _, vs in self.where for v in vs]])
            while rows := found.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def register(spark: SparkSession) -> None:
    """Make the format known, and let it take filters."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, table: str, partitions: int = PARTITIONS) -> DataFrame:
    """A table of one file, or of all files of a folder."""
    register(spark)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).load()


def write(rows: DataFrame, folder: str, table: str, key: str | None = None, index: tuple[str, ...] = ()) -> DataFrame:
    """Write a table as a file for each partition, in a folder that all executors reach as a path; returns (file, rows) of each.

    Numbers, texts and bytes are kept as they are, all else as text. A file takes its name when it is complete, so an attempt
    that is lost leaves none of that name.
    """
    kept = rows.select(*[c if t in _ARROW else rows[c].cast("string").alias(c) for c, t in ((c, {"int": "bigint"}.get(t, t)) for c, t in rows.dtypes)])
    folder, sql = _local(folder), {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
    made = ", ".join(f"{_quoted(c)} {sql[t]}{' PRIMARY KEY' * (c == key)}" for c, t in kept.dtypes)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{uuid.uuid4().hex}"
        n = 0
        con = sqlite3.connect(path)
        con.execute(f"CREATE TABLE {_quoted(table)} ({made})")
        for batch in batches:
            n += len(batch)
            con.executemany(f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * batch.num_columns)})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for c in index:
            con.execute(f"CREATE INDEX {_quoted(f'{table}_{c}')} ON {_quoted(table)} ({_quoted(c)})")
        con.commit()
        con.close()
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId() if task else 0:05}.sqlite"
        os.replace(path, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "rows": [n]})

    files = [tuple(r) for r in kept.mapInArrow(put, "file string, rows long").collect()]  # a row a file
    if not files:  # no partitions: an empty table, which no task has made
        files = [(r["file"], r["rows"]) for b in put(iter(())) for r in b.to_pylist()]
    return rows.sparkSession.createDataFrame(files, "file string, rows long")
