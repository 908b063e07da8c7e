"""The guarded SQL surface: databases by alias, listings, reading, explaining, writing, exporting, paging."""

from __future__ import annotations

import base64
import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import redact_connection
from ..sources import sqlite, tables
from ..sources.files import capped
from . import guard

ROWS_DEFAULT, ROWS_MOST = 200, 5000
PAGE_DEFAULT, PAGE_MOST = 50, 500
OVERVIEW_MOST = 100
#: Binary values above so many bytes are shown by their size.
BINARY_MOST = 64 << 10

#: What a JDBC session runs first, so that it can only read.
READ_ONLY = {"sqlite": "PRAGMA query_only = 1", "postgres": "SET default_transaction_read_only = on"}
_SYSTEM = "('pg_catalog', 'information_schema', 'sys')"
_LISTED = f"SELECT table_schema AS s, table_name AS n, CASE table_type WHEN 'VIEW' THEN 'view' ELSE 'table' END AS t FROM information_schema.tables WHERE table_schema NOT IN {_SYSTEM}"
#: Tables and views of an engine.
LISTINGS = {"sqlite": "SELECT NULL AS s, name AS n, type AS t FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite%'", "postgres": _LISTED, "sqlserver": _LISTED}
_SCHEMES = {"sqlite": "jdbc:sqlite:", "postgres": "jdbc:postgresql:", "sqlserver": "jdbc:sqlserver:"}


@dataclass(frozen=True)
class Database:
    """A database: how it is named and reached, what its tables are, and how one is read."""

    alias: str
    engine: str
    connection: str
    list: Callable[[SparkSession], list[tuple[str | None, str, str]]]
    load: Callable[[SparkSession, str], DataFrame]

    def register(self, spark: SparkSession) -> None:
        """All tables as temporary views."""
        for schema, name, _ in self.list(spark):
            self.load(spark, f"{schema}.{name}" if schema else name).createOrReplaceTempView(name)

    def redacted(self) -> str:
        """The connection without its password."""
        return re.sub(r"(?i)\b(password|pwd|pass)(\s*)=\s*[^;&]*", r"\1\2=***", re.sub(r"(://[^\s:/@]+:)[^\s@/]+@", r"\1***@", self.connection))


def folder_database(alias: str, folder: str) -> Database:
    """The Parquet tables of a folder."""
    return Database(alias, "parquet", folder, lambda spark: [(None, n, "table") for n in tables.names(spark, folder)], lambda spark, name: tables.load(spark, folder, name))


def jdbc_database(alias: str, engine: str, url: str, listed: tuple[str, ...] = ()) -> Database:
    """A database behind a JDBC driver of the class path; sessions only read where the engine has a setting for it."""
    url = url if url.startswith("jdbc:") else _SCHEMES.get(engine, "jdbc:") + url

    def read(spark: SparkSession, **what: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).options(**what)
        return (reader.option("sessionInitStatement", READ_ONLY[engine]) if engine in READ_ONLY else reader).load()

    def names(spark: SparkSession) -> list[tuple[str | None, str, str]]:
        if listed:
            return [(None, n, "table") for n in listed]
        return [(r[0], r[1], r[2]) for r in read(spark, query=LISTINGS[engine]).collect()]  # one row for each table

    return Database(alias, engine, url, names, lambda spark, name: read(spark, dbtable=name))


def sqlite_database(alias: str, path: str) -> Database:
    """A SQLite file, or a folder of files of the same tables, read in ranges of row ids without a driver; keys are the files' own."""

    def names(spark: SparkSession) -> list[tuple[str | None, str, str]]:
        return [(None, n, "table") for n in sqlite.keys(path)]

    return Database(alias, "sqlite", path, names, lambda spark, name: sqlite.read(spark, path, name))


class Registry:
    """Databases by alias, in any case. A single one is the default."""

    def __init__(self) -> None:
        self._found: dict[str, Database] = {}

    def add(self, database: Database) -> None:
        if database.alias.lower() in self._found:
            raise ValueError(f"Alias {database.alias!r} is taken.")
        self._found[database.alias.lower()] = database

    def add_spec(self, spec: str) -> None:
        """``alias=parquet:folder``, ``alias=sqlite:file``, ``alias=postgres:...``, ``alias=sqlserver:...`` or ``alias=jdbc:url?table,table``."""
        m = re.fullmatch(r"([\w-]+)=(parquet|sqlite|postgres|sqlserver|jdbc):(.+)", spec.strip())
        if not m:
            raise ValueError(f"Unknown kind of database: {spec!r}")
        alias, kind, where = m.groups()
        if kind == "parquet":
            return self.add(folder_database(alias, where))
        if kind == "sqlite":
            return self.add(sqlite_database(alias, where))
        url, _, listed = where.rpartition("?") if kind == "jdbc" else (where, "", "")
        return self.add(jdbc_database(alias, kind, url or where, tuple(listed.split(",")) if url and listed else ()))

    @classmethod
    def from_environment(cls, variable: str = "STRATA_DATABASES") -> Registry:
        """The databases that an environment variable lists, one on a line or between semicolons before an alias."""
        found = cls()
        for spec in re.split(r"\n|;(?=[\w-]+=(?:parquet|sqlite|postgres|sqlserver|jdbc):)", os.environ.get(variable, "")):
            if spec.strip():
                found.add_spec(spec)
        return found

    def __iter__(self) -> Iterator[Database]:
        return iter([self._found[k] for k in sorted(self._found)])

    def get(self, alias: str | None = None) -> Database:
        if alias is None and len(self._found) == 1:
            return next(iter(self._found.values()))
        if (alias or "").lower() not in self._found:
            raise KeyError(f"No database {alias!r}; known: {', '.join(sorted(self._found))}")
        return self._found[alias.lower()]

    def listing(self, spark: SparkSession) -> DataFrame:
        """(alias, engine, connection, reachable, error) of each database; one that fails is a row, not a failure."""
        rows = []
        for d in self:
            try:
                ping(spark, d)
                rows.append((d.alias, d.engine, d.redacted(), True, None))
            except Exception as e:  # whatever a driver raises
                rows.append((d.alias, d.engine, d.redacted(), False, (str(e) or type(e).__name__).splitlines()[0]))
        return spark.createDataFrame(rows, "alias string, engine string, connection string, reachable boolean, error string")


def ping(spark: SparkSession, database: Database) -> None:
    """Raise unless the database can be listed."""
    if not database.list(spark) and database.engine == "parquet" and not tables.exists(spark, database.connection):
        raise FileNotFoundError(database.connection)


def list_tables(spark: SparkSession, database: Database, search: str | None = None) -> DataFrame:
    """(schema, table, type, n_rows) by name; ``search`` is a part of the schema's or table's name in any case.

    Counts of Parquet tables come from footers; other engines are not counted.
    """
    wanted = (search or "").lower()
    found = [x for x in database.list(spark) if wanted in x[1].lower() or wanted in (x[0] or "").lower()]
    out = spark.createDataFrame(found, "schema string, table string, type string")
    if database.engine != "parquet" or not found:
        return out.withColumn("n_rows", F.lit(None).cast("long")).orderBy("schema", "table")
    counts = None
    for _, name, _ in found:
        one = database.load(spark, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return out.join(F.broadcast(counts), "table").select("schema", "table", "type", "n_rows").orderBy("schema", "table")  # a row for each table


_COLUMNS = "table string, ordinal int, column string, type string, nullable boolean, primary_key boolean, references string"


def describe(spark: SparkSession, database: Database, table: str, keys: tables.Keys | None = None) -> DataFrame:
    """(table, ordinal, column, type, nullable, primary_key, references) of a table; keys are those that the caller declares."""
    return spark.createDataFrame(_described(spark, database, guard.identifier(table), keys), _COLUMNS)


def _described(spark: SparkSession, database: Database, table: str, keys: tables.Keys | None) -> list[tuple]:
    if keys is None and database.engine == "sqlite" and not database.connection.startswith("jdbc:"):
        keys = sqlite.keys(database.connection)
    primary, foreign = (keys or {}).get(table, ((), {}))
    fields = database.load(spark, table).schema.fields
    return [(table, i, f.name, f.dataType.simpleString(), f.nullable, f.name in primary, ".".join(foreign[f.name]) if f.name in foreign else None) for i, f in enumerate(fields, 1)]


def overview(spark: SparkSession, database: Database, keys: tables.Keys | None = None, most: int = OVERVIEW_MOST) -> DataFrame:
    """(table, type, columns, references, error) of up to ``most`` tables.

    A column is its name and type, PK and NOT NULL; a table that cannot be described keeps its row, with the error.
    """
    rows = []
    for schema, name, kind in sorted(database.list(spark), key=lambda x: (x[0] or "", x[1]))[:most]:
        full = f"{schema}.{name}" if schema else name
        try:
            found = _described(spark, database, full, keys)
            rows.append((full, kind, [f"{c} {t}{' PK' * pk}{'' if null else ' NOT NULL'}" for _, _, c, t, null, pk, _ in found], [f"{c} -> {ref}" for _, _, c, _, _, _, ref in found if ref], None))
        except Exception as e:  # whatever a driver raises
            rows.append((full, kind, None, None, (str(e) or type(e).__name__).splitlines()[0]))
    return spark.createDataFrame(rows, "table string, type string, columns array<string>, references array<string>, error string")


def rendered(df: DataFrame) -> DataFrame:
    """``df`` with values that JSON can hold: numbers, booleans and texts stay; times are ISO texts; binaries are base 64, or
    their size where they are large; arrays are rendered by element; anything else is a text."""
    return df.select(*[_shown(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _shown(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _shown(x, kind.elementType))
    if isinstance(kind, (T.NumericType, T.BooleanType, T.StringType)):
        return value
    if isinstance(kind, T.BinaryType):
        size = F.octet_length(value)
        return F.when(size > BINARY_MOST, F.concat(F.lit("<"), size.cast("string"), F.lit(" bytes>"))).otherwise(F.translate(F.base64(value), "\r\n", ""))  # Spark breaks lines
    if isinstance(kind, T.TimestampNTZType):  # without trailing zeros of the fraction
        return _fraction(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    if isinstance(kind, T.TimestampType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSxxx")
    return value.cast("string")


def _fraction(text: Column) -> Column:
    """A time without the trailing zeros of its fraction, nor the point that they leave."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def read_query(spark: SparkSession, sql: str, params: dict[str, Any] | None = None, most: int = ROWS_DEFAULT) -> DataFrame:
    """A guarded query with named parameters (@name or :name), of at most ``most`` rows, each with ``truncated``.

    The text is checked first, then the analyzed plan: commands are refused whatever they are called.
    """
    return capped(_checked(spark, sql, params), _clamped(most, ROWS_MOST))


def _clamped(n: int | None, most: int) -> int:
    return max(1, min(n if n is not None else most, most))


def _checked(spark: SparkSession, sql: str, params: dict[str, Any] | None) -> DataFrame:
    guard.ensure_read(sql)
    df = spark.sql(_prepared(sql), args=params or {})
    if "Command" in df._jdf.queryExecution().analyzed().getClass().getSimpleName() and not re.match(r"\s*(SHOW|DESC|EXPLAIN)", sql, re.IGNORECASE):
        raise guard.GuardError("Commands are not allowed here.")
    return df


def _prepared(sql: str) -> str:
    return guard.named_parameters(sql).strip().rstrip("; \t\r\n")


@dataclass(frozen=True)
class Result:
    """The rows of a query on the driver: at most ROWS_MOST, rendered."""

    columns: list[str]
    types: list[str]
    rows: list[tuple]
    truncated: bool
    elapsed_ms: int


def query_result(spark: SparkSession, sql: str, params: dict[str, Any] | None = None, most: int = ROWS_DEFAULT) -> Result:
    """read_query's rows, collected. Whether there were more is known from one row more than is asked for."""
    began = time.perf_counter()
    df = _checked(spark, sql, params)
    most = _clamped(most, ROWS_MOST)
    rows = [tuple(r) for r in rendered(df).limit(most + 1).collect()]
    return Result(df.columns, [f.dataType.simpleString() for f in df.schema.fields], rows[:most], len(rows) > most, int((time.perf_counter() - began) * 1000))


def explain_query(spark: SparkSession, sql: str, params: dict[str, Any] | None = None) -> DataFrame:
    """The plan of a reading statement, without running it."""
    guard.ensure_read(sql)
    return spark.sql("EXPLAIN FORMATTED " + _prepared(sql), args=params or {})


def write_query(spark: SparkSession, sql: str, params: dict[str, Any] | None = None, read_only: bool = True) -> int | None:
    """Run a writing statement, where the caller has switched writing on; returns the rows that it wrote, if Spark counts them."""
    if read_only:
        raise guard.GuardError("Writing is switched off.")
    guard.ensure_write(sql)
    plan = spark.sql(_prepared(sql), args=params or {})._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() != "CommandResultExec":
        return None
    metrics = plan.commandPhysicalPlan().metrics()
    return metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else None


def csv_lines(df: DataFrame, order: list[str], most: int = ROWS_MOST) -> DataFrame:
    """(line_no, line) of up to ``most`` rows: a header, then a line for each row.

    Values are quoted only where they must be, nulls are empty. A whole table is written by export_csv.
    """

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(F.regexp_like(text, F.lit('[",\n]')), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    head = df.sparkSession.createDataFrame([(0, ",".join(df.columns))], "line_no long, line string")
    some = df.orderBy(*order).limit(most)  # so the window sees few rows
    number = F.row_number().over(Window.orderBy(*order)).cast("long")
    return head.unionByName(some.select(number.alias("line_no"), F.concat_ws(",", *map(cell, df.columns)).alias("line")))


def export_csv(df: DataFrame, path: str) -> None:
    """A distributed export: one file for each partition, with the same quoting."""
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    """A JSON object for each row; nulls are left out. Duplicate column names are an error."""
    if len({c.lower() for c in df.columns}) < len(df.columns):
        raise ValueError("Duplicate column names.")
    return df.select(F.to_json(F.struct("*")).alias("json"))


def export_query(spark: SparkSession, sql: str, order: list[str], kind: str = "csv", params: dict[str, Any] | None = None, most: int = ROWS_MOST) -> DataFrame:
    """A guarded query's rows as lines of "csv", or as objects of "json"."""
    if kind not in ("csv", "json"):
        raise ValueError("csv or json")
    rows = _checked(spark, sql, params)
    return csv_lines(rows, order, _clamped(most, ROWS_MOST)) if kind == "csv" else json_rows(rows.orderBy(*order).limit(_clamped(most, ROWS_MOST)))


def page_token(offset: int) -> str:
    return base64.b64encode(f"o:{offset}".encode()).decode()


def page_offset(token: str | None) -> int:
    """The offset in a token of page_token; no token is the first page."""
    if not token:
        return 0
    try:
        kind, _, n = base64.b64decode(token, validate=True).decode().partition(":")
        if kind == "o" and int(n) >= 0:
            return int(n)
    except ValueError:
        pass
    raise ValueError("Not a page token.")


def page(df: DataFrame, order: list[str], token: str | None = None, size: int = PAGE_DEFAULT) -> DataFrame:
    """The rows of one page in a total order, each with ``total`` and ``next_token``, which is null on the last page."""
    at, size = page_offset(token), _clamped(size, PAGE_MOST)
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    following = F.when(F.col("total") > at + size, F.lit(page_token(at + size)))
    return df.orderBy(*order).offset(at).limit(size).crossJoin(F.broadcast(total)).withColumn("next_token", following)


def server_info(spark: SparkSession) -> DataFrame:
    """(engine, version, parallelism, time_zone) of this session."""
    return spark.createDataFrame([("spark", spark.version, spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.session.timeZone"))], "engine string, version string, parallelism int, time_zone string")


def redacted(connections: DataFrame, column: str) -> DataFrame:
    """Connection strings without their passwords."""
    return connections.withColumn(column, redact_connection(F.col(column)))
