"""Tables in Parquet folders: discovering, loading, registering as views; a folder for what the library itself writes."""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A table's keys, which Parquet cannot hold: its primary key, and for each referring column (table, column).
Keys = dict[str, tuple[tuple[str, ...], dict[str, tuple[str, str]]]]


def listing(spark: SparkSession, folder: str) -> list[tuple[str, bool, int, int]]:
    """(name, is_folder, bytes, modified in ms) of what is in a folder, by name; by Spark's own file systems. No folder is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    found = [(f.getPath().getName(), f.isDirectory(), f.getLen(), f.getModificationTime()) for f in store.listStatus(path)]
    return sorted(found)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The tables of a folder: its entries that end in .parquet, in order."""
    return [name[: -len(".parquet")] for name, *_ in listing(spark, folder) if name.endswith(".parquet")]


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; only the columns and row groups that a query needs are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` by hash of a key over several tasks a core: for few bytes that much work follows from, which files alone would leave to one task."""
    return rows.repartition(max(64, 4 * rows.sparkSession.sparkContext.defaultParallelism), key)


def placed(rows: DataFrame, name: str) -> DataFrame:
    """A table as load() gives it with ``name``, a number that grows with a row's place: files by name, rows in their file."""
    files = sorted(rows.inputFiles(), key=unquote)  # as input_file_name() writes them, which _metadata.file_path does not
    order = rows.sparkSession.createDataFrame(list(enumerate(files)), "_file long, _path string")
    met = rows.withColumn("_path", F.input_file_name()).withColumn(name, F.col("_metadata.row_index")).join(F.broadcast(order), "_path", "left")  # a row a file
    file = F.coalesce("_file", F.raise_error(F.concat(F.lit("No file of the table: "), F.col("_path"))).cast("long"))
    return met.withColumn(name, F.shiftleft(file, 40) + F.col(name)).drop("_path", "_file")


def register(spark: SparkSession, folder: str) -> None:
    """All tables of a folder as temporary views."""
    for name in names(spark, folder):
        load(spark, folder, name).createOrReplaceTempView(name)


def work_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; the warehouse where that is unset and all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        found = spark.conf.get("spark.sql.warehouse.dir")
    return found.rstrip("/") + "/strata"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder with all in it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def version(spark: SparkSession, folder: str, name: str) -> str:
    """A name for a table's present files: it changes when a file, its size or its time does."""
    whole = [f for f in listing(spark, folder) if f[0] == f"{name}.parquet"] + listing(spark, f"{folder}/{name}.parquet")
    return hashlib.md5(repr((folder, name, whole)).encode(), usedforsecurity=False).hexdigest()


def staged(df: DataFrame, name: str, packed: str | None = None) -> DataFrame:
    """``df`` written to the work folder and read back, which cuts its lineage; drop() deletes it. ``packed`` names a codec other than the session's."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=packed)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a table's files in a folder, without those of folders in it."""
    return sum(length for _, is_folder, length, _ in listing(spark, path) if not is_folder)


#: Bytes of Parquet that one task of a shuffle takes: what is packed there is many times larger as rows in memory.
PART_BYTES = 8 << 20


def parts(spark: SparkSession, held: int) -> tuple[int, ...]:
    """The number of tasks that ``held`` bytes of Parquet are shuffled to, to be put before the columns; none where the session's own are enough.

    So a task's rows fit its memory, and are not spilled, however large the table is.
    """
    n = -(-held // PART_BYTES)
    return (n,) if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else ()


def drop(*found: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in found:
        remove(df.sparkSession, df.staged_at)


def numbered(rows: DataFrame, order: list, name: str, first: int = 1) -> DataFrame:
    """``rows`` with ``name``: their numbers from ``first``, without gaps, in an order; the columns _part and _before are taken.

    Rows are dealt to ranges of the order and written; each range is numbered by itself and moved on by the sizes of those
    before it, so no task holds more than a range.
    """
    dealt = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_before"))
    before = F.sum("_before").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn(name, place).join(F.broadcast(starts), "_part").withColumn(name, (F.col(name) + F.col("_before") + (first - 1)).cast("long")).drop("_part", "_before")
