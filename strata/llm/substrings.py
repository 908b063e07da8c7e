"""Substring dedup: words of windows that also start earlier are removed, found through a count-min prefilter."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import windows as W
from .common import fresh, remove_path, small_batches, stage, table

SPAN = 20
#: Windows estimated repeated that a task holds before it settles them among themselves.
HELD = 1 << 18
#: Text bytes for each group of windows and of documents, and the least number of groups.
GROUP_BYTES, GROUPS = 4 << 20, 256

_ROWS = "bucket long, kind int, keys binary, ids binary, nulls binary, marks binary, at binary, places binary"
_ARROW = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), *[(n, pa.binary()) for n in ("keys", "ids", "nulls", "marks", "at", "places")]])
_RANGES = pa.schema([("doc_id", pa.int64()), ("mark", pa.int32()), ("ranges", pa.binary())])


def _hashes(span: int):
    def found(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offsets in W.chunks(texts):
            words, bounds, _ = W.word_hashes(data, offsets)
            yield W.window_hashes(words, bounds, None, span)[0]

    return found


class _Docs:
    """Documents in their order: id, nulls last, then mark. Equal ones are one."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, marks: np.ndarray):
        order = np.lexsort((marks, ids, nulls))
        a, b, c = ids[order], nulls[order], marks[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        self.ids, self.nulls, self.marks = a[new], b[new], c[new]
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.cumsum(new) - 1

    def buckets(self, n: int) -> np.ndarray:
        return (W.mix(self.ids.view(np.uint64) ^ self.marks.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _pack(bucket: int, kind: int, keys: bytes, docs: _Docs, rank: np.ndarray, place: np.ndarray) -> dict:
    used, at = np.unique(rank, return_inverse=True)
    return {"bucket": bucket, "kind": kind, "keys": keys, "ids": W.planes(docs.ids[used]), "nulls": W.planes(docs.nulls[used].astype(np.uint8)), "marks": W.planes(docs.marks[used]), "at": W.planes(at.astype("<u4")), "places": W.planes(place.astype("<u4"))}


def _unpack(rows: list[dict]) -> tuple[_Docs, np.ndarray, np.ndarray]:
    """(documents, rank, place) of packed rows together."""
    ids, nulls, marks, at, place, n = [], [], [], [], [], 0
    for r in rows:
        ids.append(W.unplanes(r["ids"], np.int64))
        nulls.append(W.unplanes(r["nulls"], np.uint8))
        marks.append(W.unplanes(r["marks"], np.int32))
        at.append(W.unplanes(r["at"], "<u4").astype(np.int64) + n)
        place.append(W.unplanes(r["places"], "<u4").astype(np.int64))
        n += len(ids[-1])
    docs = _Docs(np.concatenate(ids), np.concatenate(nulls), np.concatenate(marks))
    return docs, docs.rank[np.concatenate(at)], np.concatenate(place)


def _later(hashes: np.ndarray, checks: np.ndarray, rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by window, then start; firsts in that order; those in that order that start after their first)."""
    start = (rank.astype(np.int64) << 32) | place
    order = np.lexsort((start, checks, hashes))
    h, c, s = hashes[order], checks[order], start[order]
    first = np.ones(len(order), bool)
    first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
    return order, first, s != s[lead]


def _removed(docs: _Docs, rank: np.ndarray, place: np.ndarray, groups: int) -> Iterator[dict]:
    """Windows to remove, packed by the group of their document."""
    bucket = docs.buckets(groups)[rank]
    order = np.lexsort((place, rank, bucket))
    bucket, rank, place = bucket[order], rank[order], place[order]
    for a, b in W.spans(bucket):
        yield _pack(int(bucket[a]), 1, b"", docs, rank[a:b], place[a:b])


def _in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _mark():
    """Tells documents of one id apart by their texts."""
    return F.shiftright(F.xxhash64(F.coalesce("text", F.lit(""))), 32).cast("int")


def find_repeats(docs: DataFrame, span: int = SPAN, held_most: int = HELD, max_bits: int = W.MAX_BITS) -> DataFrame:
    """(doc_id, mark, ranges): for each document the words covered by windows that also start earlier.

    1. Each task sketches its windows; the sketches are merged.
    2. Each task reads its texts again and groups the windows that the sketch estimates repeated, by a fingerprint
       of 96 bits from two independent hashes; a window that occurs once is one of them only where cells
       collide, and one that occurs twice always is. All but the first of ``held_most`` windows are to be
       removed; the firsts meet those of other tasks by hash, so a window in any share of all documents sends one
       row for so many held.
    3. What is to be removed is gathered by document.
    With more windows than a sketch's 2 ** max_bits cells, 1 and 2 go through the texts once for each range of the
    hashes, up to W.MAX_RANGES times. ``ranges`` are pairs of 32-bit numbers: first word, end.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"))
    total = W.text_bytes(rows)
    bits, parts = W.sketch_size(total, max_bits)
    groups = max(GROUPS, total // GROUP_BYTES)

    def settle(held: list[tuple[np.ndarray, ...]], ids: list[np.ndarray], nulls: list[np.ndarray], marks: list[np.ndarray]) -> Iterator[dict]:
        known = _Docs(np.concatenate(ids), np.concatenate(nulls), np.concatenate(marks))
        h, c, row, place = (np.concatenate(x) for x in zip(*held, strict=True))
        rank = known.rank[row]
        order, first, later = _later(h, c, rank, place)
        yield from _removed(known, rank[order[later]], place[order[later]], groups)
        lead = order[first]
        h, c, rank, place = h[lead], c[lead], rank[lead], place[lead]
        bucket = ((h >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
        for a, b in W.spans(bucket):
            by = np.lexsort((place[a:b], rank[a:b])) + a
            yield _pack(int(bucket[a]), 0, h[by].tobytes() + c[by].tobytes(), known, rank[by], place[by])

    def local(batches: Iterator[pa.RecordBatch], path: str, part: int) -> Iterator[dict]:
        known = W.estimates(path, bits)
        held, ids, nulls, marks, n, base = [], [], [], [], 0, 0
        for batch in batches:
            for at, count, data, offsets in W.chunks(batch.column(0)):
                h, c, row, place = W.window_hashes(*W.word_hashes(data, offsets, twice=True), span)
                ask = known.repeated(h)
                if parts > 1:
                    ask &= W.in_range(h, part, parts)
                held.append((h[ask], (c[ask] >> np.uint64(32)).astype("<u4"), (row[ask] + base).astype(np.int32), place[ask].astype(np.int32)))
                id_ = batch.column(1).slice(at, count)
                nulls.append(np.asarray(id_.is_null()).astype(np.uint8))
                ids.append(np.asarray(id_.fill_null(0)).astype(np.int64))
                marks.append(np.asarray(batch.column(2).slice(at, count)).astype(np.int32))
                base += count
                n += int(ask.sum())
                if n >= held_most:
                    yield from settle(held, ids, nulls, marks)
                    held, ids, nulls, marks, n, base = [], [], [], [], 0, 0
        if n:
            yield from settle(held, ids, nulls, marks)

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        W.release()
        every = rows.to_pylist()
        out = [r for r in every if r["kind"] == 1]
        if mine := [r for r in every if r["kind"] == 0]:
            known, rank, place = _unpack(mine)
            h = np.concatenate([np.frombuffer(r["keys"], np.uint64, len(r["keys"]) // 12) for r in mine])
            c = np.concatenate([np.frombuffer(r["keys"], "<u4", offset=len(r["keys"]) // 12 * 8) for r in mine])
            order, _, later = _later(h, c, rank, place)
            out += _removed(known, rank[order[later]], place[order[later]], groups)
        return pa.Table.from_pylist(out, _ARROW)

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        known, rank, place = _unpack(rows.to_pylist())
        order = np.lexsort((place, rank))
        rank, place = rank[order], place[order]
        begin = np.ones(len(rank), bool)
        begin[1:] = (rank[1:] != rank[:-1]) | (place[1:] > place[:-1] + span)
        cuts = np.flatnonzero(begin)
        ends = np.concatenate([place[cuts[1:] - 1], place[-1:]]) + span
        pairs, whose = np.stack([place[cuts], ends], 1).astype("<i4"), rank[cuts]
        out = [{"doc_id": None if known.nulls[whose[a]] else int(known.ids[whose[a]]), "mark": int(known.marks[whose[a]]), "ranges": pairs[a:b].tobytes()} for a, b in W.spans(whose)]
        return pa.Table.from_pylist(out, _RANGES)

    firsts, paths = [], []
    with small_batches(spark):
        for part in range(parts):
            paths.append(W.sketch(rows, bits, _hashes(span), part, parts))
            firsts.append(rows.mapInArrow(lambda batches, path=paths[-1], part=part: _in_batches(local(batches, path, part), _ARROW), _ROWS))
        met = reduce(DataFrame.unionByName, firsts).groupBy("bucket").applyInArrow(meet, _ROWS)
        found = stage(met.groupBy("bucket").applyInArrow(gather, "doc_id long, mark int, ranges binary"), "repeats")
    for path in paths:
        remove_path(spark, path)
    return found


_CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])


@F.arrow_udf(_CUT)
def cut_words(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    """The words of each text but those in its ranges, joined by one space, with counts."""
    W.release()
    out = []
    for text, found in zip(texts, ranges, strict=True):
        kept = (text.as_py() or "").encode().split()  # of bytes: at 9 to 13 and 32
        n = len(kept)
        if (found := found.as_py()) is not None:
            for first, end in np.frombuffer(found, "<i4").reshape(-1, 2)[::-1].tolist():
                del kept[first:end]
        out.append((b" ".join(kept).decode(), n, n - len(kept)))
    text, n_words, n_removed = zip(*out, strict=True) if out else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["text", "n_words", "n_removed"])


def drop_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents with their kept words as text, and n_words (before) and n_removed.

    A window is ``span`` consecutive words of a document, whole texts are read, and windows are judged on the
    input. Documents are ordered by doc_id, null last, and by a hash of the text where ids repeat; rows equal in
    both are one document and get one result. Null and empty texts give empty ones; texts shorter than a window
    lose nothing but their spacing; no rows give none. Existing columns n_words and n_removed are replaced; all
    others are kept, whatever their names.
    """
    docs = docs.drop("n_words", "n_removed")
    mark, id_, mark_, ranges, cut = fresh(docs, "mark", "id", "mark2", "ranges", "cut")
    found = find_repeats(docs, span).withColumnsRenamed({"doc_id": id_, "mark": mark_, "ranges": ranges})
    rows = docs.withColumn(mark, _mark())
    met = rows.join(found, rows["doc_id"].cast("long").eqNullSafe(found[id_]) & (rows[mark] == found[mark_]), "left")
    met = met.withColumn(cut, cut_words(F.col("text").cast("string"), F.col(ranges)))
    same = [F.col(f"{cut}.text").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return met.select(*same, F.col(f"{cut}.n_words").alias("n_words"), F.col(f"{cut}.n_removed").alias("n_removed"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document, and a digest of what is left."""
    rows = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(list_slice(w, i, i + 19), ' ')) ORDER BY doc_id, i) AS k FROM p),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM g, range(20) AS t(j) WHERE k > 1),
x AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT x.doc_id, count(c.i)::BIGINT AS n_removed, coalesce(string_agg(CASE WHEN c.i IS NULL THEN v END, ' ' ORDER BY x.i), '') AS kept
      FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
