"""Windows of words over Arrow batches: hashes of words and of windows, and count-min sketches of them.

Words are hashed byte by byte through tables of random numbers, one for each place in a word, so no pattern of bytes
makes words collide, as a power series modulo 2 ** 64 would let some; longer words than the tables have places for are
digested whole. A second set of tables gives every word a second, independent hash.

A sketch has ROWS rows of 2 ** bits cells. Each task counts its own windows; only cells that it has met travel,
in blocks of BLOCK cells, and blocks of one number are added. A window's estimate is the least of its cells, so
it is never below the true count. A sketch counts one range of the hashes: with more windows than cells there are
several ranges, so a worker's memory is bounded and estimates stay as sharp.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

#: Bytes of text whose arrays are held at once, but for a single longer text.
CHUNK_BYTES = 1 << 18
ROWS = 2
BLOCK_BITS = 20
#: Cells of a row at most: 2 ** MAX_BITS bits are 32 MB, in each worker for each row.
MAX_BITS = 28
#: Ranges of hashes at most. Each costs two more passes over the texts; with more windows estimates only get larger.
MAX_RANGES = 16
#: From this estimate on a window counts as frequent.
MANY = 16
#: Windows whose cells a task holds before it adds them up and passes them on.
HELD = 2 << 20
#: Bytes of a word that have a table of their own.
PLACES = 64

_U = np.uint64
_WORD, _CHECK = _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_ROW = (_U(0xFF51AFD7ED558CCD), _U(0xD6E8FEB86659FD93))
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on all bits of ``x``."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    inverse = pow(base, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)]), dtype=_U) for b in (base, inverse))


def _sums(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values times powers of the base up to each place, and the inverse powers."""
    n = max(1 << 17, 1 << int(len(values)).bit_length())
    up, down = _powers(int(base), n)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets of the rows in them) of a text column; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, stop - at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


@lru_cache(1)
def _tables() -> np.ndarray:
    """For each of two hashes a random number for each place in a word and each byte, the same in every process."""
    n = 2 * PLACES * 256 * 8
    raw = b"".join(hashlib.blake2b(i.to_bytes(8, "little"), digest_size=64, person=b"word bytes").digest() for i in range(n // 64))
    return np.frombuffer(raw, "<u8").astype(_U).reshape(2, PLACES * 256)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, twice: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(hash of each word, first word of each row and the end, a second hash if asked for).

    Words are runs of bytes but 9 to 13 and 32.
    """
    if lower:
        data = _LOWER[data]
    n = len(data)
    full = ~_BLANK[data]
    begin, end = full.copy(), full.copy()
    begin[1:] &= ~full[:-1]
    end[:-1] &= ~full[1:]
    cuts = offsets[:-1][offsets[:-1] < n]
    begin[cuts] = full[cuts]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    end[cuts] = full[cuts]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    bounds = np.searchsorted(first, offsets)
    if not len(first):
        return np.zeros(0, _U), bounds, np.zeros(0, _U) if twice else None
    sizes = (last - first).astype(np.int32)
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    place = np.arange(starts[-1] + sizes[-1], dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    at = (np.minimum(place, PLACES - 1) << 8) + data[full]
    out = [np.add.reduceat(t[at], starts) for t in _tables()[: 1 + twice]]
    for i in np.flatnonzero(sizes > PLACES).tolist():
        digest = hashlib.blake2b(data[first[i] : last[i]].tobytes(), digest_size=16, person=b"long word").digest()
        for h, part in zip(out, (digest[:8], digest[8:]), strict=False):
            h[i] = int.from_bytes(part, "little")
    return mix(out[0]), bounds, mix(out[1]) if twice else None


def window_hashes(words: np.ndarray, bounds: np.ndarray, checks: np.ndarray | None, span: int, short: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """(hash, check, row, place in the row) of all windows of ``span`` words in one row.

    hash comes from the words' first hashes, check from their second ones: together they are a fingerprint of 128
    bits. With ``short``, a row of fewer words, but some, is one window.
    """
    counts = np.diff(bounds)
    sizes = np.maximum(counts - (span - 1), ((counts > 0) & short).astype(counts.dtype))
    row = np.repeat(np.arange(len(counts)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = bounds[:-1][row] + place
    last = np.minimum(first + span, bounds[1:][row])
    out = []
    for base, values in ((_WORD, words), (_CHECK, checks)):
        if values is None:
            out.append(None)
            continue
        sums, down = _sums(values, base)
        out.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(_U)))
    return out[0], out[1], row, place


def spans(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if len(values):
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        yield from zip(cuts, cuts[1:], strict=False)


def planes(array: np.ndarray) -> bytes:
    """The bytes of numbers by place, so that equal high bytes stand together, compressed."""
    return zlib.compress(np.ascontiguousarray(array.view(np.uint8).reshape(len(array), -1).T), 1)


def unplanes(data: bytes, kind) -> np.ndarray:
    """The numbers of planes()."""
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def _gaps(cells: np.ndarray) -> bytes:
    """Sorted distinct numbers by their gaps. A first byte tells how: 0, gaps of a byte, where 255 goes on; 1, compressed planes of
    wider ones, for cells that lie far apart."""
    gap = np.diff(cells, prepend=0)
    if len(gap) and cells[-1] >= 128 * len(gap):
        return b"\1" + planes(gap.astype("<u4"))
    more = gap // 255
    out = np.full(int(more.sum()) + len(gap), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gap % 255
    return b"\0" + out.tobytes()


def _ungaps(data: bytes) -> np.ndarray:
    if data[0]:
        return np.cumsum(unplanes(data[1:], "<u4"), dtype=np.int64)
    gaps = np.frombuffer(data, np.uint8, offset=1)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def _cell(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes ^ (hashes >> _U(29))) * _ROW[row]) >> _U(64 - bits)


SKETCH = pa.schema([("row", pa.int32()), ("block", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])


def in_range(hashes: np.ndarray, part: int, parts: int) -> np.ndarray | slice:
    """Which hashes are in range ``part`` of ``parts``."""
    return slice(None) if parts == 1 else (hashes >> _U(5)) % _U(parts) == _U(part)


class Counter:
    """Counts the cells of a task, HELD windows at a time."""

    def __init__(self, bits: int):
        self.bits = bits
        self.held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        self.n = 0

    def add(self, hashes: np.ndarray) -> None:
        for r in range(ROWS):
            self.held[r].append(_cell(hashes, r, self.bits).astype(np.uint32))
        self.n += len(hashes)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The blocks met since the last call, in rows of SKETCH."""
        for r in range(ROWS):
            if not self.held[r]:
                continue
            cells = np.concatenate(self.held[r])
            self.held[r] = []
            cells.sort()
            first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
            counts = np.minimum(np.diff(first, append=len(cells)), 65535).astype("<u2")
            cells = cells[first]
            rows: list[dict] = []
            for a, b in spans(cells >> np.uint32(BLOCK_BITS)):
                inside = (cells[a:b] & np.uint32((1 << BLOCK_BITS) - 1)).astype(np.int64)
                rows.append({"row": r, "block": int(cells[a]) >> BLOCK_BITS, "cells": _gaps(inside), "counts": zlib.compress(counts[a:b], 1)})
                if len(rows) == 64:
                    yield pa.RecordBatch.from_pylist(rows, SKETCH)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, SKETCH)
        self.n = 0


_MERGED = pa.schema([("row", pa.int32()), ("block", pa.int64()), ("twice", pa.binary()), ("many", pa.binary()), ("logs", pa.binary())])


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(1 << BLOCK_BITS, np.int64)
    for cells, counts in zip(table.column("cells"), table.column("counts"), strict=True):
        total[_ungaps(cells.as_py())] += np.frombuffer(zlib.decompress(counts.as_py()), "<u2")
    many = np.flatnonzero(total >= MANY)
    logs = np.log2(total[many]).astype(np.uint8)
    row = {"row": key[0].as_py(), "block": key[1].as_py(), "twice": np.packbits(total >= 2, bitorder="little").tobytes(), "many": many.astype("<u4").tobytes(), "logs": logs.tobytes()}
    return pa.Table.from_pylist([row], _MERGED)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def sketch_size(total: int, max_bits: int = MAX_BITS, max_ranges: int = MAX_RANGES) -> tuple[int, int]:
    """(bits of a cell's number, ranges) for texts of so many bytes, at six bytes a word: a cell or two for each window of a range."""
    bits = max(BLOCK_BITS, min(max_bits, int(total // 6).bit_length()))
    return bits, max(1, min(max_ranges, -(-int(total // 6) >> max_bits)))


def sketch(docs: DataFrame, bits: int, hashes, part: int = 0, parts: int = 1) -> str:
    """Sketch what ``hashes(texts)`` yields over all texts, in one range; returns the path of the merged blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counter = Counter(bits)
        for batch in batches:
            for found in hashes(batch.column(0)):
                counter.add(found[in_range(found, part, parts)])
                if counter.n >= HELD:
                    yield from counter.batches()
        yield from counter.batches()

    path = new_path(docs.sparkSession, "sketch")
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "row int, block long, cells binary, counts binary")
    counted.groupBy("row", "block").applyInArrow(_merge, "row int, block long, twice binary, many binary, logs binary").write.parquet(path)
    return path


class Estimates:
    """A merged sketch in a worker's memory."""

    def __init__(self, path: str, bits: int):
        self.bits = bits
        store, folder = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.twice = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(ROWS)]
        many: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        logs: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        for f in store.get_file_info(pafs.FileSelector(folder)):
            if not f.path.endswith(".parquet"):
                continue
            for batch in pq.ParquetFile(store.open_input_file(f.path)).iter_batches(batch_size=64):
                for r, block, twice, cells, log in zip(*[batch.column(i) for i in range(5)], strict=True):
                    r, at = r.as_py(), block.as_py() << (BLOCK_BITS - 3)
                    self.twice[r][at : at + (1 << (BLOCK_BITS - 3))] = np.frombuffer(twice.as_py(), np.uint8)
                    many[r].append(np.frombuffer(cells.as_py(), "<u4").astype(np.int64) + (block.as_py() << BLOCK_BITS))
                    logs[r].append(np.frombuffer(log.as_py(), np.uint8))
        self.many, self.logs = [], []
        for r in range(ROWS):
            cells = np.concatenate(many[r] or [np.zeros(0, np.int64)])
            order = np.argsort(cells)
            self.many.append(cells[order])
            self.logs.append(np.concatenate(logs[r] or [np.zeros(0, np.uint8)])[order])

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        """Whether the estimate is 2 or more."""
        out = np.ones(len(hashes), bool)
        for r in range(ROWS):
            cell = _cell(hashes, r, self.bits).astype(np.int64)
            out &= (self.twice[r][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return out

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        """0: the estimate is 1; 1: below MANY; else the logarithm of the estimate to base 2."""
        out = np.full(len(hashes), 64, np.uint8)
        for r in range(ROWS):
            cell = _cell(hashes, r, self.bits).astype(np.int64)
            at = np.minimum(np.searchsorted(self.many[r], cell), max(0, len(self.many[r]) - 1))
            hit = self.many[r][at] == cell if len(self.many[r]) else np.zeros(len(cell), bool)
            found = ((self.twice[r][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(np.uint8)
            found[hit] = self.logs[r][at[hit]]
            np.minimum(out, found, out=out)
        return out


_LOADED: dict[tuple[str, int], Estimates] = {}


def release() -> None:
    """Give back what this worker holds of sketches, and memory that only allocators hold."""
    _LOADED.clear()
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()


def estimates(path: str, bits: int) -> Estimates:
    """The sketch at a path, loaded once in each worker; the one before is let go first."""
    if (path, bits) not in _LOADED:
        release()
        _LOADED[path, bits] = Estimates(path, bits)
    return _LOADED[path, bits]


def estimates_of(spark: SparkSession, path: str, bits: int) -> Estimates:
    """The same on the driver, for tests."""
    del spark
    return Estimates(path, bits)
