"""Streaming forms: debounced changes, a rolling cap, dedup, decayed sums, upserts of files as they come."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

#: Parts of a table that upsert_stream keeps; a batch rewrites those that it touches.
BUCKETS = 16


def _marked(events: DataFrame, at: str, late: str | None) -> DataFrame:
    """A stream with a watermark; None for ``late`` keeps the one that a step before has set."""
    return events.withWatermark(at, late) if events.isStreaming and late else events


def debounced(events: DataFrame, key: str, at: str = "ts", quiet: str = "2 seconds", late: str | None = "10 minutes") -> DataFrame:
    """(key, begin, finish, n): changes of a key closer than ``quiet`` are one; batch and streaming alike."""
    grouped = _marked(events, at, late).groupBy(key, F.session_window(at, quiet).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), "n")


def rolling(events: DataFrame, at: str = "ts", span: str = "24 hours", step: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """(begin, finish, n): rows in each sliding span."""
    grouped = _marked(events, at, late).groupBy(F.window(at, span, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), "n")


def deduplicated(events: DataFrame, keys: list[str], at: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key; state is dropped after ``late``."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def watch(spark: SparkSession, folder: str, schema, files_a_batch: int = 100) -> DataFrame:
    """Rows of Parquet files as they appear in a folder, older files first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream gives now, as a table in memory; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_now(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stream has finished by now, written to ``path``: rows that its watermark has passed."""
    schema = stream.schema
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(path)


def decayed(events: DataFrame, key: str, at: str, value: str, as_of, half_life_days: float) -> DataFrame:
    """(key, total): values halved for each half-life of their age; decayed_stream keeps the same from rows as they come."""
    days = F.greatest((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 86400e6, F.lit(0.0))
    return events.groupBy(key).agg(F.sum(F.col(value) * F.pow(F.lit(0.5), days / half_life_days)).alias("total"))


#: Parts that decayed_stream leaves before it adds them up.
PARTS = 32


def _sums(rows: DataFrame, key: str, micros, value, ref: int, half_life_days: float) -> DataFrame:
    """(key, ref, total): values halved for each half-life between their time and ``ref``, which may lie before it."""
    return rows.groupBy(key).agg(F.sum(value * F.pow(F.lit(0.5), (F.lit(ref) - micros) / 86400e6 / half_life_days)).alias("total")).select(key, F.lit(ref).cast("long").alias("ref"), "total")


def decayed_stream(stream: DataFrame, target: str, key: str, at: str, value: str, half_life_days: float, checkpoint: str) -> None:
    """Keep in ``target`` decayed sums, which decayed_total() gives as of any time.

    A part (key, ref, total) is a sum as of a time of its own. Parts add up once they are brought to one time, in any order,
    so a batch writes one and reads none; it has the batch's number, so a batch that is given again writes it again.
    After PARTS of them all before the last are added up. Rows without a time count for nothing.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark, micros = batch.sparkSession, F.unix_micros(F.col(at).cast("timestamp"))
        last = batch.agg(F.max(micros)).first()[0]
        if last is None:
            return
        _sums(batch.where(F.col(at).isNotNull()), key, micros, F.col(value), last, half_life_days).write.mode("overwrite").parquet(f"{target}/part={number}")
        before = [p for p in _decayed_parts(spark, target) if p != f"part={number}"]
        if len(before) >= PARTS:
            rows = spark.read.parquet(*[f"{target}/{p}" for p in before])
            _sums(rows, key, F.col("ref"), F.col("total"), last, half_life_days).write.mode("overwrite").parquet(f"{target}/upto={number - 1}")
            for p in before:
                tables.remove(spark, f"{target}/{p}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _decayed_parts(spark: SparkSession, target: str) -> list[str]:
    """The folders that count: the last sum that is complete, and parts after it."""
    found = {k: [int(n.partition("=")[2]) for n, *_ in tables.listing(spark, target) if n.startswith(f"{k}=") and tables.exists(spark, f"{target}/{n}/_SUCCESS")] for k in ("upto", "part")}
    top = max(found["upto"], default=-1)
    return [f"upto={top}"] * (top >= 0) + [f"part={n}" for n in sorted(found["part"]) if n > top]


def decayed_total(spark: SparkSession, target: str, key: str, as_of, half_life_days: float) -> DataFrame:
    """(key, total) of what decayed_stream has kept, as of a time."""
    now = spark.range(1).select(F.unix_micros(F.lit(as_of).cast("timestamp"))).first()[0]
    rows = spark.read.parquet(*[f"{target}/{p}" for p in _decayed_parts(spark, target)])
    return _sums(rows, key, F.col("ref"), F.col("total"), now, half_life_days).select(key, "total")


def upsert_stream(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str, buckets: int = BUCKETS) -> None:
    """Keep in ``target`` the row of each key that is last in ``order``, whichever batch brought it.

    Keys are dealt to buckets. A batch writes anew those that it touches, then a list of where each bucket stands,
    and only then takes effect; a replayed batch changes nothing. What neither of the last two lists names is deleted.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        last, where = _state(spark, target)
        place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = _last(batch, keys, order).withColumn("_bucket", place)
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        old = _buckets(spark, target, {b: v for b, v in where.items() if b in touched})
        rows = new if old is None else _last(new.unionByName(old.withColumn("_bucket", place)), keys, order)
        rows.write.partitionBy("_bucket").mode("overwrite").parquet(f"{target}/v={last + 1}")
        where |= dict.fromkeys(touched, last + 1)
        spark.createDataFrame(sorted(where.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{target}/list={last + 1}")
        keep = set(where.values()) | set(_listed(spark, target, last).values() if last >= 0 else ())
        for name, *_ in tables.listing(spark, target):
            kind, _, n = name.partition("=")
            if (kind == "v" and int(n) not in keep and int(n) <= last) or (kind == "list" and int(n) < last):
                tables.remove(spark, f"{target}/{name}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")


def _listed(spark: SparkSession, target: str, n: int) -> dict[int, int]:
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{target}/list={n}").collect()}


def _state(spark: SparkSession, target: str) -> tuple[int, dict[int, int]]:
    """(number of the last complete list, or -1; the version of each bucket)."""
    found = [int(n[5:]) for n, *_ in tables.listing(spark, target) if n.startswith("list=") and tables.exists(spark, f"{target}/{n}/_SUCCESS")]
    return (max(found), _listed(spark, target, max(found))) if found else (-1, {})


def _buckets(spark: SparkSession, target: str, where: dict[int, int]) -> DataFrame | None:
    return spark.read.parquet(*[f"{target}/v={v}/_bucket={b}" for b, v in sorted(where.items())]) if where else None


def latest(spark: SparkSession, target: str) -> DataFrame | None:
    """The table that upsert_stream keeps."""
    return _buckets(spark, target, _state(spark, target)[1])


def replayed(rows: DataFrame, parts: int, part, flush: DataFrame | None = None, files: int | None = 1) -> tuple[str, object]:
    """(folder, schema) of a table written as files that a stream reads one by one: rows by ``part`` (0 to parts - 1), in the
    order last part, first, second and so on, then the first once more, then ``flush``. For tests of late and repeated files.
    Each is ``files`` files; with None as many as its rows come in, so that no task holds them all."""
    import time

    spark = rows.sparkSession
    folder = f"{tables.work_folder(spark)}/replay-{uuid.uuid4().hex}"
    order = [parts - 1, *range(parts - 1), 0]
    pieces = [rows.where(part == p) for p in order] + ([flush] if flush is not None else [])
    for piece in pieces:
        piece = piece.select(*rows.columns)
        (piece.coalesce(files) if files else piece).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are read in order of their times
    return folder, rows.schema
