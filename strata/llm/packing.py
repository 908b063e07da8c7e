"""Best-fit packing: sequences are planned over counts of lengths, then pieces take their places by rank."""

from __future__ import annotations

import base64
import zlib
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stage, table, with_rank

#: Tokens of a sequence, the id that ends a document, and the vocabulary, by name or by path.
CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The added token of the vocabulary's JSON form, which the ranks do not list.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(2)
def encoder(vocabulary: str):
    """The encoder of a vocabulary of ranks; strings of special tokens become those tokens, as in the JSON form."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of ``capacity`` but the first, which may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32, and ids (little-endian 32 bits) if asked for.

    A null text is empty; a document always ends with ``end_id``, so it has one piece at least.
    """
    schema = _ARROW.append(pa.field("ids", pa.binary())) if with_ids else _ARROW

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = encoder(vocabulary).encode_to_numpy
        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode_one(text.as_py() or "", allowed_special="all"), end_id).astype("<u4")
                for piece, (start, n) in enumerate(cut(len(ids), capacity)):
                    raw = ids[start : start + n].tobytes()
                    out.append((k.as_py(), piece, start, n, zlib.crc32(raw), *([raw] if with_ids else [])))
                if with_ids and len(out) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, _PIECES + (", ids binary" if with_ids else ""))


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int, int]]], int]:
    """Best-fit decreasing over counts; returns (plan, sequences).

    For each length the plan lists (first rank, end rank, first sequence, pieces in each sequence, offset).
    Sequences that hold the same are kept as ranges, so time and size depend on the lengths, not on the pieces.
    A piece goes to the fullest sequence that it fits; while it fits again, that one stays the fullest, so each
    sequence of a range takes as many as it can before the next.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left: ranges of sequences (first, count)
    rooms: list[int] = []
    plan: dict[int, list[tuple[int, int, int, int, int]]] = {}
    made = 0

    def put_back(room: int, first: int, count: int) -> None:
        if room not in free:
            free[room] = []
            insort(rooms, room)
        free[room].append((first, count))

    for length in sorted((n for n in counts if counts[n]), reverse=True):
        left, rank, steps = counts[length], 0, []

        def fill(room: int, first: int, count: int) -> int:
            """Put pieces into sequences of a range; returns how many sequences got any."""
            nonlocal left, rank
            each, used = room // length, 0
            for per, n in ((each, min(count, left // each)), (left % each, 1)):
                if n and per and used < count:
                    steps.append((rank, rank + n * per, first + used, per, capacity - room))
                    put_back(room - per * length, first + used, n)
                    rank, left, used = rank + n * per, left - n * per, used + n
            return used

        for room in [r for r in rooms if r >= length]:
            kept = []
            for first, count in free.pop(room):
                used = fill(room, first, count) if left else 0
                if used < count:
                    kept.append((first + used, count - used))
            if kept:
                free[room] = kept
            else:
                rooms.remove(room)
            if not left:
                break
        if left:
            count = -(-left // (capacity // length))
            fill(capacity, made, count)
            made += count
        plan[length] = steps
    return plan, made


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...); ``rows`` is read twice and should be staged.

    Only the counts of lengths, at most ``capacity`` rows, go to the driver, and a plan of bounded size comes
    back. Pieces take their places by rank within length; a length may hold any share of them.
    """
    spark = rows.sparkSession
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    plan, _ = plan_best_fit(counts, capacity)
    step = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "end", "sequence", "each", "offset")])
    table_ = T.StructType([T.StructField("length", T.LongType()), T.StructField("_steps", T.ArrayType(step))])
    plans = F.broadcast(spark.createDataFrame([(k, v) for k, v in plan.items()], table_))  # a row for each length
    ranked = with_rank(rows, ["length"], ["doc_id", "piece"], "_rank").join(plans, "length")
    mine = F.get(F.filter("_steps", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["end"])), F.lit(0))
    ranked = ranked.withColumn("_s", mine).withColumn("_k", F.col("_rank") - F.col("_s.first"))
    sequence = F.col("_s.sequence") + F.expr("_k div _s.each")
    return ranked.select(*rows.columns, sequence.alias("sequence_id"), (F.col("_s.offset") + F.col("_k") % F.col("_s.each") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """All pieces of all documents in sequences of at most ``capacity`` tokens, as few as best-fit decreasing gives.

    A text longer than a sequence is cut into whole sequences but for its first piece, however long it is; a null or
    empty text is its end alone. No documents give no rows; repeated rows are packed each; extra columns are not carried.
    """
    with small_batches(docs.sparkSession):
        made = stage(pieces(docs, vocabulary, capacity, end_id, with_ids), "pieces")
    return place(made, capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document tokenized, cut and packed."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
