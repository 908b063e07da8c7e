"""Sharding: longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stage, table, with_rank

#: A group is scheduled alone if it holds over 1 / (shards * ALONE) of all bytes; so at most shards * ALONE are.
ALONE = 64
#: Classes of size in each power of two for all other groups; so the driver sees at most 64 * CLASSES of them.
CLASSES = 256


@dataclass(frozen=True)
class ShardPlan:
    """What the driver decided. ``alone``: digest to shard. ``ends``: class to the rank at which each shard ends."""

    alone: dict[str, int]
    ends: dict[int, list[int]]
    loads: list[float]


class _Loads:
    """Shards in a heap by load, then number."""

    def __init__(self, n: int):
        self.heap = [(0.0, i) for i in range(n)]

    def put(self, size: float) -> int:
        load, shard = self.heap[0]
        heapq.heapreplace(self.heap, (load + size, shard))
        return shard

    def put_many(self, size: float, count: int) -> list[int]:
        """As ``count`` calls of put(size), in time that does not depend on ``count``.

        The shards are first filled up to a common level, as the heap would; what is left, fewer than one item
        for each shard, goes through the heap.
        """
        taken = [0] * len(self.heap)
        low, high = min(self.heap)[0], max(self.heap)[0] + size * (count // len(self.heap) + 1)
        fits = lambda level: sum(max(0, int((level - load) // size)) for load, _ in self.heap)
        for _ in range(200):
            middle = (low + high) / 2
            if middle in (low, high):
                break
            low, high = (middle, high) if fits(middle) <= count else (low, middle)
        grown = []
        for load, shard in self.heap:
            k = max(0, int((low - load) // size))
            taken[shard] += k
            grown.append((load + k * size, shard))
        heapq.heapify(grown)
        self.heap = grown
        for _ in range(count - sum(taken)):
            taken[self.put(size)] += 1
        return taken


def plan_shards(alone: list[tuple[str, int]], classes: list[tuple[int, int, int]], n_shards: int) -> ShardPlan:
    """Longest first: ``alone`` are (digest, size), ``classes`` are (class, groups, bytes); both of bounded length."""
    loads = _Loads(n_shards)
    items = [(-size, 0, digest, 1, size) for digest, size in alone]
    items += [(-(total / n), 1, cls, n, total / n) for cls, n, total in classes if n]
    placed, ends = {}, {}
    for _, kind, key, n, size in sorted(items):
        if kind == 0:
            placed[key] = loads.put(size)
        else:
            at, row = 0, []
            for k in loads.put_many(size, n):
                at += k
                row.append(at)
            ends[key] = row
    return ShardPlan(placed, ends, [load for load, _ in sorted(loads.heap, key=lambda x: x[1])])


def _class_of(size):
    """Classes of nearly equal sizes; sizes below CLASSES have one each."""
    return F.when(size < CLASSES, -size).otherwise(F.floor(F.log2(size) * CLASSES)).cast("int")


def assign_shards(rows: DataFrame, n_shards: int, group: str = "digest", size: str = "size", order: str = "doc_id") -> DataFrame:
    """Add ``shard`` (0 to n_shards - 1) and ``slot`` (from 0, without gaps in a shard) to every row.

    Rows with equal ``group`` stay together, so a group larger than an even share makes its shard the largest.
    Groups are scheduled by longest processing time: the driver gets the largest groups one by one (at most
    n_shards * ALONE) and counts by class of size for the others, and answers with rank ranges; neither grows
    with the rows. A group takes the shard of its rank in its class. ``rows`` is read several times and should
    be staged. Null sizes count as 0 and null groups are a group. No rows give no rows; repeated rows are a group and get slots
    of their own. Other columns stay, whatever their names; existing ones named shard and slot are replaced.
    """
    spark = rows.sparkSession
    extra = [c for c in rows.columns if c not in ("shard", "slot")]
    hidden = [c for c in extra if c[:1] == "_"]
    if hidden:  # names like those used here wait under others
        names = dict(zip(hidden, fresh(rows, *[f"kept_{i}" for i in range(len(hidden))]), strict=True))
        found = assign_shards(rows.withColumnsRenamed(names), n_shards, *(names.get(c, c) for c in (group, size, order)))
        return found.withColumnsRenamed({n: c for c, n in names.items()})
    rows = rows.select(*extra).withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit("")))
    groups = rows.groupBy("_g").agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("_size"))
    groups = stage(groups.withColumn("_size", F.greatest("_size", F.lit(1))), "shard-groups")
    total = groups.agg(F.sum("_size")).first()[0] or 0
    big = F.col("_size") * (n_shards * ALONE) > F.lit(total)
    alone = [(r[0], r[1]) for r in groups.where(big).select("_g", "_size").orderBy(F.desc("_size"), "_g").collect()]
    small = groups.where(~big).withColumn("_class", _class_of(F.col("_size")))
    counts = small.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("b")).collect()
    plan = plan_shards(alone, [tuple(r) for r in counts], n_shards)

    kinds = T.StructType([T.StructField("_class", T.IntegerType()), T.StructField("_ends", T.ArrayType(T.LongType()))])
    ends = spark.createDataFrame(list(plan.ends.items()), kinds)
    ranked = with_rank(small, ["_class"], ["_g"], "_rank").join(ends, "_class")
    shard = F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).alias("shard")
    kinds = T.StructType([T.StructField("_g", T.StringType()), T.StructField("shard", T.IntegerType())])
    placed = ranked.select("_g", shard).unionByName(spark.createDataFrame(list(plan.alone.items()), kinds))
    # One key may hold a third of the rows: a plain sort-merge join, whose large partitions Spark splits.
    dealt = stage(rows.join(placed.hint("merge"), "_g"), "shard-rows")
    return with_rank(dealt, ["shard"], ["_g", order], "slot").select(*extra, "shard", "slot")


def write_shards(rows: DataFrame, path: str) -> None:
    """Write rows that have a shard and a slot as one folder for each shard, in the order of their slots.

    Values, nulls, empty and long texts and repeated rows are written as they are; no rows make a folder without shards.
    """
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Documents to shards of nearly equal bytes; equal texts stay together, and a null text counts as an empty one.

    Size: UTF-8 bytes and 1 for the end. Repeated rows stay together and get slots of their own, no rows give none. Returns doc_id, size, text_crc32, law ("bytes"), shard, slot and
    grown_shard (null: this law makes no promise on another number of shards).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"))
    out = assign_shards(stage(rows, "shard-input"), n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards."""
    return shard_documents(table(spark, sf_dir, "documents"), 16)
