"""Named queries over the test tables, each with the same question in DuckDB's SQL where that can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T
from ..operators import guard
from ..sources import tables

AS_OF = "2024-01-31 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Keys of the test tables.
KEYS: tables.Keys = {
    "region": (("r_regionkey",), {}),
    "nation": (("n_nationkey",), {"n_regionkey": ("region", "r_regionkey")}),
    "customer": (("c_custkey",), {"c_nationkey": ("nation", "n_nationkey")}),
    "supplier": (("s_suppkey",), {"s_nationkey": ("nation", "n_nationkey")}),
    "part": (("p_partkey",), {}),
    "orders": (("o_orderkey",), {"o_custkey": ("customer", "c_custkey")}),
    "lineitem": (("l_orderkey", "l_linenumber"), {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}),
    "events": (("event_id",), {}),
    "documents": (("doc_id",), {}),
    "embeddings": (("vec_id",), {}),
    "pages": (("page_id",), {}),
    "benchmark": (("item_id",), {}),
    "labels": (("doc_id",), {"doc_id": ("documents", "doc_id")}),
    "conversations": (("conv_id", "turn"), {}),
}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL twin."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def both(name: str, sql: str, spark_sql: str | None = None) -> None:
    """Register one text as a guarded query on both sides, or a Spark wording of it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables.register(spark, sf_dir)
        guard.ensure_read(spark_sql or sql)
        return spark.sql(spark_sql or sql)

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


TOK = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x))"


def tok(column: str) -> str:
    """The words of a column, in DuckDB."""
    return TOK.format(f"coalesce({column}, '')")


def bm25_sql(table: str, key: str, fields: dict[str, float], terms: list[str], prefix: bool, most: int | None, digits: int = 6) -> str:
    """Weighted BM25 over a table, or over a query in brackets, in DuckDB: (key, score)."""
    words = " UNION ALL ".join(f"SELECT {key}, unnest({tok(f)}) AS w, {float(w)}::DOUBLE AS weight FROM {table}" for f, w in fields.items())
    length = " + ".join(f"len({tok(f)})" for f in fields)
    asked = " UNION ALL ".join(f"SELECT {i} AS p, '{t}' AS t, {str(prefix and i == len(terms) - 1).lower()} AS pre" for i, t in enumerate(terms))
    last = f" ORDER BY score DESC, {key} LIMIT {most}" if most else ""
    return f"""
    WITH q AS ({asked}), words AS ({words}), n AS (SELECT {key}, ({length})::DOUBLE AS len FROM {table}),
    s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM n),
    tf AS (SELECT {key}, p, sum(weight) AS tf FROM words JOIN q ON (w = t AND NOT pre) OR (pre AND starts_with(w, t)) GROUP BY ALL),
    df AS (SELECT p, count(*)::DOUBLE AS df FROM tf GROUP BY p)
    SELECT {key}, round(sum(greatest(ln((s.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), {digits}) AS score
    FROM tf JOIN df USING (p) JOIN n USING ({key}) CROSS JOIN s GROUP BY {key}{last}"""


def redact_sql(column: str) -> str:
    """text.redact() in DuckDB."""
    out = column
    for shape, put in T.SECRET_SHAPES:
        out = f"regexp_replace({out}, '{shape.replace(chr(39), chr(39) * 2)}', '{put.replace('$1', chr(92) + '1')}', 'g')"
    return out


def words_sql(column: str) -> str:
    """text.split_identifiers() in DuckDB."""
    parts = "t"
    for a, b in (("([a-z0-9])([A-Z])", r"\1_\2"), ("([A-Z])([A-Z][a-z])", r"\1_\2"), ("([A-Za-z])([0-9])", r"\1_\2"), ("([A-Za-z])([0-9])", r"\1_\2")):
        parts = f"regexp_replace({parts}, '{a}', '{b}', 'g')"
    split = f"list_filter(string_split({parts}, '_'), lambda y: y <> '')"
    one = f"CASE WHEN len({split}) > 1 THEN t || ' ' || lower(array_to_string({split}, ' ')) ELSE lower(t) END"
    return rf"array_to_string(list_transform(regexp_extract_all({column}, '[\p{{L}}\p{{N}}_]+'), lambda t: {one}), ' ')"
