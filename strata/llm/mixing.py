"""Mixing sources to target weights: repetition rates for each source, hash-seeded copies for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stage, table

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a source are dealt to so many tasks when they meet its rate.
SALTS = 32


def with_size(docs: DataFrame, name: str = "size") -> DataFrame:
    """Add the number of words; a null text has none."""
    return docs.withColumn(name, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))


def source_targets(sized: DataFrame, share: float, cap: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row for each source: source, source_size, target, rate.

    The targets sum to ``share`` of all sizes, by weight; none is above ``cap`` times its source's size, and
    what is cut off is shared again by weight among the others. This equals a common level: a source takes
    weight * level or its cap. In the order of cap / weight, the level is the first that its own source could
    still take. Sizes are summed before rows meet, so a source may hold any share of the rows. The windows
    hold a row for each source in one task, which sorts and spills them: meant for up to some ten million sources. A source without words has rate 0. A null source is a source of its own, last.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ratio = F.lit(cap) * F.col("source_size") / F.col("w")
    ordered = Window.orderBy("ratio", "place")
    every = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    rows = sums.withColumn("place", place).withColumn("w", weight).withColumn("ratio", ratio).withColumn("level", level)
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(every)["level"])
    target = F.coalesce(F.least(F.lit(cap) * F.col("source_size"), F.col("w") * F.col("level")), F.lit(cap) * F.col("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return rows.withColumn("target", F.round(target, 6)).select("source", "source_size", "target", rate.alias("rate"))


def draw(seed: int, doc_id: str = "doc_id", text: str = "text"):
    """A number from 0 up to 1 for each document, from its id, its text and the seed alone."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def plan_copies(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Add source_size, target and copies to rows that have source, size and u (see draw).

    copies is floor(rate), and one more if u is below the fraction of the rate: it is never above ``cap`` rounded
    up, and reruns agree. Equal rows draw alike. Rates meet the rows by source and a salt, so a hot source is
    dealt to SALTS tasks; Spark sends the rates to all tasks instead where it finds them small.
    """
    rates = stage(source_targets(sized, share, cap, weights), "rates")
    salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "_source")
    rows = sized.withColumn("_salt", F.pmod(F.floor(F.col("u") * 1e6), F.lit(SALTS)).cast("int"))
    met = rows.join(salted, (rows["_salt"] == salted["_salt"]) & rows["source"].eqNullSafe(salted["_source"]))
    copies = F.floor("rate") + F.when(F.col("u") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return met.withColumn("copies", copies.cast("int")).select(*sized.columns, "source_size", "target", "copies")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 5, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns as given.

    Null texts have no words and are taken by the same draw. Columns named size, u or copies are kept apart.
    """
    kept = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    rows = with_size(docs.select(kept, "text", "source", "doc_id")).select("_row", "source", "size", draw(seed).alias("u"))
    taken = plan_copies(rows, share, cap, weights).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document when all sources are mixed to 150 % of all words."""
    docs = table(spark, sf_dir, "documents")
    sized = stage(with_size(docs).select("doc_id", "source", "size", draw(5).alias("u")), "sizes")
    rows = plan_copies(sized)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('5:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
-- Share by weight; while some source is above twice its size, fix it there and share the rest again.
r AS (
  SELECT 0 AS i, source, source_size, w, false AS fixed, (1.5 * sum(source_size) OVER () * w / sum(w) OVER ())::DOUBLE AS target FROM s
  UNION ALL
  SELECT i + 1, source, source_size, w, over,
         CASE WHEN over THEN 2.0 * source_size ELSE (total - sum(CASE WHEN over THEN 2.0 * source_size ELSE 0 END) OVER ()) * w / sum(CASE WHEN over THEN 0 ELSE w END) OVER () END
  FROM (SELECT *, fixed OR target > 2.0 * source_size AS over, 1.5 * sum(source_size) OVER () AS total,
               max(CASE WHEN NOT fixed AND target > 2.0 * source_size THEN 1 ELSE 0 END) OVER () AS again FROM r) WHERE again = 1),
t AS (SELECT source, source_size, round(target, 6) AS target FROM r WHERE i = (SELECT max(i) FROM r))
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
"""
