"""What several operators of this package share: staging tables, dense ranks, word splitting."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Between words: space and the control characters 9 to 13. Java and RE2 read it alike.
SPACE = r"[\x20\x09-\x0D]+"
#: A word: anything but those.
WORD = r"[^\x20\x09-\x0D]+"
#: Slices into which the rows of one key are dealt before they are ranked.
SLICES = 128


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session whose executors are in the driver's own process may leave it unset: the warehouse is taken then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
    return found.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Arrow batches of at most so many rows while jobs run in here: rows hold whole texts, and batches are copied in both processes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    if 0 < int(before or 0) <= rows:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    This cuts the lineage: a lost executor costs a reread of the written files, not the work before them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def discard(*staged: DataFrame) -> None:
    """Delete the files of staged tables that no DataFrame needs any more."""
    for df in staged:
        remove_path(df.sparkSession, df.staged_at)


def keep_where(df: DataFrame, condition: str) -> DataFrame:
    """``df.where(condition)`` for conditions on costly columns.

    A plain filter is pushed below the projections that make its columns, which are then computed in the filter,
    once for each mention, and again after it. A filter on a column that is not deterministic stays where it is.
    """
    (here,) = fresh(df, "here")
    return df.withColumn(here, F.monotonically_increasing_id() >= 0).where(f"{here} and ({condition})").drop(here)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no DataFrame needs any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def running_sums(values: Column, block: int = 256) -> Column:
    """The sums of an array's numbers up to each place, as integers: block by block, so that long arrays are not copied for each number."""

    def sums(of: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        step = lambda a, v: F.struct((a["sum"] + v).cast("int").alias("sum"), F.array_append(a["out"], (a["sum"] + v).cast("int")).alias("out"))
        return F.aggregate(of, start, step, lambda a: a["out"])

    def once(of: Column, f) -> Column:
        """f of a value that is made once: inside a lambda an expression would be evaluated again for each use."""
        return F.transform(F.array(of), f)[0]

    def moved(inside: Column) -> Column:
        lasts = F.transform(inside, lambda x: F.element_at(x, -1))
        starts = F.slice(F.concat(F.array(F.lit(0)), sums(lasts)), F.lit(1), F.size(inside))
        return F.flatten(F.zip_with(inside, starts, lambda x, s: F.transform(x, lambda v: v + s)))

    cut = lambda of: F.transform(F.sequence(F.lit(0), F.size(of) - 1, F.lit(block)), lambda i: sums(F.slice(of, i + 1, block)))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(once(values, lambda of: once(cut(of), moved)))


def words(text: Column) -> Column:
    """The words of a text, in order, unchanged; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def with_rank(df: DataFrame, keys: list[str], order: list[str], name: str, slices: int = SLICES) -> DataFrame:
    """Add ``name``: each row's place from 0, without gaps, among the rows of its ``keys``.

    A key may hold any share of the rows. Its rows are dealt by hash into slices, ranked in their slice, and
    moved on by the sizes of the slices before; no task holds more than a slice of a key. ``df`` is read twice
    and should be staged. Rows equal in ``order`` and ``keys`` share a slice and may swap places.
    """
    dealt = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)) - 1
    ranked = dealt.withColumn("_local", local).join(starts, [*keys, "_slice"])
    return ranked.withColumn(name, (F.col("_local") + F.col("_start")).cast("long")).drop("_slice", "_local", "_start")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, by Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pattern(text: str) -> re.Pattern:
    """A compiled pattern, ASCII classes only."""
    return re.compile(text, re.ASCII)
