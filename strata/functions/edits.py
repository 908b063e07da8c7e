"""Changes of texts: ordered edits as a fold, and unified diffs."""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def apply_edits(text: Column, edits: list[tuple[str, str]]) -> Column:
    """(old, new) replacements in order, each at its first place in what the ones before left; null where one has no place.

    An edit whose text stands nowhere exactly is looked for once more with any blanks between its words.
    """
    if any(not old.strip() for old, _ in edits):
        raise ValueError("An edit needs a text to replace.")
    steps = F.array(*[F.struct(F.lit(old).alias("old"), F.lit(new).alias("new"), F.lit(r"\s+".join(map(re.escape, old.split()))).alias("words")) for old, new in edits])

    def step(out: Column, e: Column) -> Column:
        found = F.when(F.contains(out, e["old"]), e["old"]).otherwise(F.regexp_substr(out, e["words"]))
        at = F.position(found, out)
        return F.concat(F.substring(out, F.lit(1), at - 1), e["new"], F.substring(out, at + F.length(found), F.length(out)))

    return F.aggregate(steps, text, step) if edits else text


def unified(before: str, after: str, name: str = "file", context: int = 3) -> str:
    """The unified diff of two texts; empty where they are equal."""
    lines = lambda text: re.split(r"\r?\n", text)
    return "\n".join(difflib.unified_diff(lines(before), lines(after), f"a/{name}", f"b/{name}", n=context, lineterm=""))


@F.arrow_udf(StringType())
def diffs(before: pa.Array, after: pa.Array) -> pa.Array:
    """The unified diff of each pair of texts; nulls are empty."""
    return pa.array([unified(a or "", b or "") for a, b in zip(before.to_pylist(), after.to_pylist(), strict=True)], pa.string())
