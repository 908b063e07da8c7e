"""A catalog of other servers' tools: who is listed, what each offers, a tool's schema, results that are cut, arguments that are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT_CHARS = 8000


def discover_servers(registry: DataFrame) -> DataFrame:
    """(id, title, summary, enabled) of a registry, by id."""
    return registry.select("id", F.coalesce("title", "id").alias("title"), "summary", F.coalesce("enabled", F.lit(True)).alias("enabled")).orderBy("id")


def discover_tools(registry: DataFrame, answers: DataFrame) -> DataFrame:
    """(server, tool, schema, error): the tools (tool, schema) that each enabled server's answer (id, tools, error) lists.

    A server that gave none, or an error, is one row without a tool.
    """
    asked = registry.where(F.coalesce("enabled", F.lit(True))).select("id")
    met = asked.join(answers, "id", "left").withColumn("error", F.coalesce("error", F.when(F.col("tools").isNull(), "no answer")))
    return met.select(F.col("id").alias("server"), F.explode_outer("tools").alias("t"), "error").select("server", "t.tool", "t.schema", "error")


def tool_schema(tools: DataFrame, server: str, tool: str) -> str:
    """The schema of one tool; an unknown one is an error."""
    found = tools.where((F.col("server") == server) & (F.col("tool") == tool)).select("schema").limit(1).collect()
    if not found:
        raise LookupError(f"{server} has no tool {tool!r}.")
    return found[0][0]


def refuse_addresses(arguments: dict) -> dict:
    """``arguments``, unless one of them is a web address."""
    for name, value in arguments.items():
        if isinstance(value, str) and value.strip().lower().startswith(("http://", "https://")):
            raise ValueError(f"Addresses are not accepted: {name}")
    return arguments


def cut_results(results: DataFrame, column: str, most: int = RESULT_CHARS) -> DataFrame:
    """Results of at most ``most`` characters, and ``cut``: whether there were more."""
    return results.withColumn("cut", F.length(column) > most).withColumn(column, F.left(column, F.lit(most)))
