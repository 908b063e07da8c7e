"""Joins of points with intervals, as equal joins over bins; and sums over them without their pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import tables

#: Bits of a rank that a level of nodes takes off: a node has 2 ** STEP nodes below it.
STEP = 2


def _level(width: Column) -> Column:
    """The least power of two that is not below a width, as its exponent; from -64 on."""
    return F.greatest(F.ceil(F.log2(F.greatest(width, F.lit(2.0**-64)))), F.lit(-64)).cast("int")


def _bin(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, keys: list[str] | None = None) -> DataFrame:
    """All pairs of a point and an interval with low <= point < high and equal ``keys``: columns of both, keys once.

    An interval lies in bins as wide as the power of two next to its own width, so in at most three of them, whatever
    widths there are; a point is looked up in one bin for each level that intervals have, of which there are few. The join
    is one over equal bins; the exact condition comes after. Nulls and empty intervals meet nothing.
    """
    keys = keys or []
    lo, hi = F.col(low).cast("double"), F.col(high).cast("double")
    kept = intervals.where(lo < hi)
    dealt = kept.withColumn("_level", _level(hi - lo)).withColumn("_bin", F.explode(F.sequence(_bin(lo, F.col("_level")), _bin(hi, F.col("_level")))))
    levels = sorted(r[0] for r in kept.select(_level(hi - lo).alias("l")).distinct().collect())  # an exponent of a double each
    at = F.col(point).cast("double")
    found = points.where(at.isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", _bin(at, F.col("_level")))
    met = found.join(dealt, [*keys, "_level", "_bin"])
    return met.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_level", "_bin")


def overlap_join(a: DataFrame, b: DataFrame, low: str, high: str, keys: list[str] | None = None) -> DataFrame:
    """All pairs of intervals (``low``, ``high`` in ``a``, the same with 2 after it in ``b``) that share a point: each pair is found
    once, where the later of the two begins."""
    keys = keys or []
    later = range_join(b, a, f"{low}2", low, high, keys)  # b begins inside a
    earlier = range_join(a, b, low, f"{low}2", f"{high}2", keys).where(F.col(low) > F.col(f"{low}2"))  # a begins inside b, after b
    fits = (F.col(f"{low}2") < F.col(f"{high}2")) & (F.col(low) < F.col(high))
    return later.unionByName(earlier).where(fits)


def _ranks(values: DataFrame, asked: DataFrame) -> tuple[DataFrame, int]:
    """((v, below, upto), number of values): how many of the distinct ``values`` (v) are below, and not above, each of ``asked`` (v).

    One sort by ranges: each range counts by itself, and is moved on by the sizes of those before it.
    """
    both = values.select("v", F.lit(1).alias("own")).unionByName(asked.select("v", F.lit(0).alias("own"))).where(F.col("v").isNotNull())
    once = both.groupBy("v").agg(F.max("own").alias("own"))
    dealt = tables.staged(once.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranks")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    sizes = dealt.groupBy("part").agg(F.sum("own").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    upto = F.sum("own").over(Window.partitionBy("part").orderBy("v"))
    placed = dealt.withColumn("upto", upto).join(F.broadcast(sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))), "part")
    return placed.select("v", (F.col("start") + F.col("upto") - F.col("own")).alias("below"), (F.col("start") + F.col("upto")).alias("upto")), total


def _levels(total: int) -> range:
    return range(max(1, -(-max(total - 1, 1).bit_length() // STEP)))


def _above(rank: Column, total: int) -> Column:
    """The nodes (level, node) that hold a rank, one a level."""
    return F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright(rank, i * STEP).alias("node")) for i in _levels(total)])


def _cover(a: Column, b: Column, total: int) -> Column:
    """The fewest nodes (level, node) that hold the ranks from ``a`` to ``b`` - 1, each once."""
    width, parts, last = 1 << STEP, [], _levels(total)[-1]
    run = lambda level, x, y: F.transform(F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<long>")), lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))
    for level in _levels(total):
        # of this level's nodes those count that the nodes above, all inside, do not hold
        lo, hi = F.shiftright(a + ((1 << (level * STEP)) - 1), level * STEP), F.shiftright(b, level * STEP)
        if level == last:
            parts.append(run(level, lo, hi))
            continue
        up, down = F.floor((lo + (width - 1)) / width) * width, F.floor(hi / width) * width
        whole = up < down
        parts += [run(level, lo, F.when(whole, up).otherwise(hi)), run(level, F.when(whole, down).otherwise(hi), hi)]
    return F.concat(*parts)


def _merged(rows: DataFrame, keys: list[str], sums: tuple[str, ...], leasts: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in leasts])


def range_sums(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, keys: list[str], sums: tuple[str, ...], leasts: tuple[str, ...]) -> DataFrame:
    """(keys, sums, leasts): for each group of ``intervals`` by ``keys`` the sums and least values of columns of the points with
    low <= point < high, each as often as an interval of the group holds it. Groups that hold no point are left out.

    Pairs are never made. Points are added up by their distinct values, then by nodes of a tree over the values' ranks; an
    interval takes the few nodes that it consists of, some for each level, so the work grows with both sides, not with their product.
    """
    p = points.where(F.col(point).isNotNull()).withColumn("v", F.col(point).cast("double"))
    p = tables.staged(_merged(p, ["v"], sums, leasts), "values")
    i = intervals.where(F.col(low) < F.col(high)).select(*keys, F.col(low).cast("double").alias("_lo"), F.col(high).cast("double").alias("_hi"))
    ranks, total = _ranks(p, i.select(F.explode(F.array("_lo", "_hi")).alias("v")))
    nodes = _merged(p.join(ranks, "v").select(F.explode(_above(F.col("below"), total)).alias("at"), *sums, *leasts).select("at.level", "at.node", *sums, *leasts), ["level", "node"], sums, leasts)
    ends = i.join(ranks.select(F.col("v").alias("_lo"), F.col("below").alias("a")), "_lo").join(ranks.select(F.col("v").alias("_hi"), F.col("below").alias("b")), "_hi")
    taken = ends.select(*keys, F.explode(_cover(F.col("a"), F.col("b"), total)).alias("at")).select(*keys, "at.level", "at.node")
    return _merged(taken.join(nodes, ["level", "node"]), keys, sums, leasts)


def stab_sums(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, keys: list[str], sums: tuple[str, ...], leasts: tuple[str, ...]) -> DataFrame:
    """(keys, sums, leasts): for each group of ``points`` by ``keys`` the sums and least values of columns of the intervals with
    low < point < high, by the same nodes: intervals are added up by those that they consist of, points look at all above them."""
    p = points.where(F.col(point).isNotNull()).select(*keys, F.col(point).cast("double").alias("v"))
    i = intervals.where(F.col(low) < F.col(high)).withColumn("_lo", F.col(low).cast("double")).withColumn("_hi", F.col(high).cast("double"))
    i = tables.staged(_merged(i, ["_lo", "_hi"], sums, leasts), "intervals")
    ranks, total = _ranks(p, i.select(F.explode(F.array("_lo", "_hi")).alias("v")))
    ends = i.join(ranks.select(F.col("v").alias("_lo"), F.col("upto").alias("a")), "_lo").join(ranks.select(F.col("v").alias("_hi"), F.col("below").alias("b")), "_hi")
    nodes = _merged(ends.select(F.explode(_cover(F.col("a"), F.col("b"), total)).alias("at"), *sums, *leasts).select("at.level", "at.node", *sums, *leasts), ["level", "node"], sums, leasts)
    asked = p.join(ranks, "v").select(*keys, F.explode(_above(F.col("below"), total)).alias("at")).select(*keys, "at.level", "at.node")
    return _merged(asked.join(nodes, ["level", "node"]), keys, sums, leasts)


def overlap_sums(a: DataFrame, b: DataFrame, low: str, high: str, keys: list[str], sums: tuple[str, ...], leasts: tuple[str, ...]) -> DataFrame:
    """(keys, sums, leasts): what overlap_join() and a grouping by ``keys`` of ``a`` give for columns of ``b``, without the pairs."""
    fits = a.where(F.col(low) < F.col(high))
    later = range_sums(b.where(F.col(f"{low}2") < F.col(f"{high}2")), fits, f"{low}2", low, high, keys, sums, leasts)
    earlier = stab_sums(fits, b, low, f"{low}2", f"{high}2", keys, sums, leasts)
    return _merged(later.unionByName(earlier), keys, sums, leasts)
