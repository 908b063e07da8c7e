"""The terms of each text with their counts or places, in Arrow batches: a text has all its words in one row, so nothing is shuffled."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stem

#: Fields that a place can tell apart.
FIELDS = 16
#: Rows of a batch, and bytes of their texts, that are grouped at once; a longer text is grouped alone.
PART, PART_BYTES = 8192, 32 << 20
#: Postings of a term that a block holds at most, so that a frequent term is many rows, which ranges can part.
BLOCK = 256
#: Bits of a row's number: the segment that gave it, the task, the row in the task; blocks of postings count from a number near.
SEGMENT_BITS, TASK_BITS, ROW_BITS, NEAR_BITS = 20, 17, 26, 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), 95])


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter or a number."""
    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)])


def _mark_others(data: np.ndarray, word: np.ndarray) -> None:
    """Mark the bytes of letters and numbers beyond ASCII; ``data`` ends in four bytes 0. What is no UTF-8 is in no word."""
    for size, lead, least in ((2, 0xC0, 0x80), (3, 0xE0, 0x800), (4, 0xF0, 0x10000)):
        at = np.flatnonzero((data >= lead) & (data < lead + (0x80 >> size)))
        point = (data[at] - lead).astype(np.int64)
        fits = np.ones(len(at), bool)
        for i in range(1, size):
            more = data[at + i]
            fits &= more & 0xC0 == 0x80
            point = point << 6 | more & 0x3F
        fits &= (point >= least) & (point < 0x110000)
        at = at[fits][_letters()[point[fits]]]
        for i in range(size):
            word[at + i] = True


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(words of each row, the words), with A to Z lower-cased: T.tokens() but for other capitals."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, held = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.empty(0, np.uint8)
    at = at - at[0]
    word = _WORD[data]
    if len(data) and data.max() >= 0x80:
        word = np.append(word, np.zeros(4, bool))
        _mark_others(np.append(data, np.zeros(4, np.uint8)), word)
        word = word[: len(data)]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    rows = at[:-1][at[:-1] < len(data)]
    begins[rows] = word[rows]  # no word goes on in the next row
    offsets = np.append(np.flatnonzero(begins[word]), np.count_nonzero(word))
    size = np.diff(np.searchsorted(np.flatnonzero(begins), at))
    kept = _LOWER[data[word]]
    return size, pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept))


@lru_cache(1)
def _unmarked() -> dict[int, int]:
    return str.maketrans(*T._marked())


def _mapped(terms: pa.Array, chosen: pa.Array, change) -> pa.Array:
    """Terms with ``change`` made to those that are chosen."""
    made = pa.array([change(w) for w in terms.filter(chosen).to_pylist()], pa.string())
    return pc.replace_with_mask(terms, chosen, made)


def _coded(words: pa.Array, stemmed: bool) -> tuple[np.ndarray, pa.Array]:
    """(the term of each word, the distinct terms in order)."""
    coded = words.dictionary_encode()
    codes, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())
    other = pc.invert(pc.string_is_ascii(terms))
    if pc.any(other).as_py():
        terms = _mapped(terms, other, lambda w: (w.translate(_unmarked()) if stemmed else w).lower())
    if stemmed:
        terms = _mapped(terms, pc.match_substring_regex(terms, "^[a-z]{3,}$"), stem)
    coded = terms.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[coded.indices.to_numpy()][codes], coded.dictionary.take(pa.array(order))


def _grouped(fields: list[pa.Array], stemmed: bool) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows' texts by field: (words of each row, the terms in order, term and row of each posting, its first place, places)."""
    n, seen, places, rows, words = len(fields[0]), 0, [], [], []
    for no, field in enumerate(fields):
        size, found = _tokens(field)
        at = np.arange(size.sum()) + np.repeat(seen - (np.cumsum(size) - size), size)
        places.append((at + 1 + no) * FIELDS + no)
        rows.append(np.repeat(np.arange(n), size))
        words.append(found)
        seen = seen + size
    codes, terms = _coded(pa.concat_arrays(words), stemmed)
    n_words = max(len(codes), 1)
    both = np.sort((codes * n + np.concatenate(rows)) * n_words + np.arange(len(codes)))  # a row's places grow from field to field
    both, order = np.divmod(both, n_words)
    first = np.flatnonzero(np.diff(both, prepend=-1))
    term, row = np.divmod(both[first], max(n, 1))
    return seen, terms, term, row, first, np.concatenate(places)[order].astype(np.int32)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most PART rows and about PART_BYTES of text."""
    size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
    upto, i = np.cumsum(size), 0
    while i < batch.num_rows:
        n = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PART_BYTES, "right")) - i
        n = min(max(n, 1), PART)
        yield batch.slice(i, n)
        i += n


def _values(first: np.ndarray, places: np.ndarray, weights: np.ndarray, placed: bool) -> pa.Array:
    """A value for each posting: its places, or the sum of its fields' weights."""
    if placed:
        return pa.ListArray.from_arrays(pa.array(np.append(first, len(places)).astype(np.int32)), pa.array(places))
    return pa.array(np.add.reduceat(weights[places % FIELDS], first) if len(first) else np.empty(0))


def _listed(row: np.ndarray, term: np.ndarray, terms: pa.Array, n: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(postings in order of rows, offsets of the rows, their terms)."""
    order = np.argsort(row * max(len(terms), 1) + term)
    return order, _offsets(np.bincount(row, minlength=n)), terms.take(pa.array(term[order]))


def own_terms(docs: DataFrame, key: str, fields: dict[str, float], placed: bool = False, stemmed: bool = False) -> DataFrame:
    """(key, length, terms, tfs) of each row: its words in all fields, its distinct terms, each one's sum of its fields' weights.

    ``placed`` gives places instead of tfs: a word's position over all fields times FIELDS plus its field's number, fields
    one position apart. ``stemmed`` folds diacritics and stems English terms.
    """
    weights = np.array(list(fields.values()), dtype=np.float64)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                length, terms, term, row, first, places = _grouped(part.columns[1:], stemmed)
                order, at, own = _listed(row, term, terms, part.num_rows)
                values = _values(first, places, weights, placed).take(pa.array(order))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(length.astype(np.int32)), pa.ListArray.from_arrays(at, own), pa.ListArray.from_arrays(at, values)], names=[key, "length", "terms", "places" if placed else "tfs"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return _texts(docs, key, fields).mapInArrow(group, f"`{key}` {kind}, length int, terms array<string>, " + ("places array<array<int>>" if placed else "tfs array<double>"))


def _texts(docs: DataFrame, key: str, fields) -> DataFrame:
    return docs.select(key, *[F.col(f).cast("string").alias(f"_{n}") for n, f in enumerate(fields)])


def each_term(own: DataFrame, key: str) -> DataFrame:
    """A row for each term of own_terms(): (key, length, term, tf), or with places in place of tf."""
    values, value = ("places", "places") if "places" in own.columns else ("tfs", "tf")
    # one array of both is taken apart: an array beside it would be copied for each of a row's terms
    rows = own.select(key, "length", F.explode(F.arrays_zip("terms", values)).alias("_p"))
    return rows.select(key, "length", F.col("_p.terms").alias("term"), F.col(f"_p.{values}").alias(value))


def _first_number(segment: int, task: int, seen: int, n: int) -> int:
    """The number of the first of ``n`` more rows of a task that has numbered ``seen``."""
    if segment >> SEGMENT_BITS or task >> TASK_BITS or seen + n > 1 << ROW_BITS:
        raise OverflowError(f"Rows of segment {segment}, task {task}: there are no numbers beyond {seen} rows.")
    return (segment << TASK_BITS | task) << ROW_BITS | seen


def _blocked(*codes: np.ndarray) -> np.ndarray:
    """Where blocks begin: where a code changes, and after BLOCK postings."""
    new = np.zeros(len(codes[0]), bool)
    new[:1] = True
    for c in codes:
        new[1:] |= c[1:] != c[:-1]
    begin = np.flatnonzero(new)
    return np.flatnonzero((np.arange(len(new)) - np.repeat(begin, np.diff(np.append(begin, len(new))))) % BLOCK == 0)


def _flat(begin: np.ndarray, counts: np.ndarray, places: pa.Array) -> list[pa.Array]:
    """(ends, places, most) of blocks: a posting's places end there in its block's."""
    upto, at = np.cumsum(counts), np.append(begin, len(counts)).astype(np.int32)
    before = np.concatenate([[0], upto])[at]
    ends = pa.ListArray.from_arrays(pa.array(at), pa.array((upto - np.repeat(before[:-1], np.diff(at))).astype(np.int32)))
    most = np.maximum.reduceat(counts, begin) if len(begin) else counts
    return [ends, pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), places), pa.array(most.astype(np.int32))]


def _shape(kind: str, placed: bool, numbered: bool) -> list[str]:
    """The columns of blocks."""
    keys = ["base bigint", "keys array<int>"] if numbered else [f"keys array<{kind}>", "lengths array<int>"]
    return ["term string", *keys, *(["ends array<int>", "places array<int>", "most int"] if placed else ["tfs array<double>"])]


def term_blocks(docs: DataFrame, key: str, fields: dict[str, float], placed: bool = False, stemmed: bool = False, listed: bool = False, segment: int | None = None) -> DataFrame:
    """Rows of two kinds: blocks of postings, and where ``term`` is null, (key, length) of a row of ``docs``, with ``listed`` its terms.

    A block (term, keys, lengths, tfs) is what own_terms() gives for up to BLOCK of the rows that are grouped at once, in order of terms;
    ``placed`` gives places in place of tfs, one after another with the ``ends`` of each posting's, and ``most``, the largest number
    of places. So a table of postings has a row for several of a term's postings. With ``segment``, a number of this table's own,
    rows have a number, ``row``, and a block has ``base`` and what to add to it in place of keys and lengths. A number stands as long as
    what a task gave is not made again, so rows and blocks are to be written together.
    """
    weights = np.array(list(fields.values()), dtype=np.float64)
    kind = docs.select(key).schema[0].dataType.simpleString()
    own_shape = [f"`{key}` {kind}", *(["row bigint"] if segment is not None else []), "length int", "terms array<string>"]
    shape = own_shape + _shape(kind, placed, segment is not None)
    names = [s.rpartition(" ")[0].strip("`") for s in shape]

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, held = TaskContext.get().partitionId(), 0, pa.ListArray.from_arrays
        for batch in batches:
            for part in _parts(batch):
                length, terms, term, row, first, places = _grouped(part.columns[1:], stemmed)
                n, length = part.num_rows, pa.array(length.astype(np.int32))
                own = [part.column(0), length, held(*_listed(row, term, terms, n)[1:]) if listed else pa.nulls(n, pa.list_(pa.string()))]
                begin, chosen = _blocked(term), pa.array(row)
                at = pa.array(np.append(begin, len(term)).astype(np.int32))
                if segment is None:
                    keys = [held(at, part.column(0).take(chosen)), held(at, length.take(chosen))]
                else:
                    base = _first_number(segment, task, seen, n)
                    own.insert(1, pa.array(base + np.arange(n)))
                    keys = [pa.array(np.full(len(begin), base)), held(at, pa.array(row.astype(np.int32)))]
                blocks = [terms.take(pa.array(term[begin])), *keys]
                blocks += _flat(begin, np.diff(np.append(first, len(places))), pa.array(places)) if placed else [held(at, _values(first, places, weights, False))]
                seen += n
                yield pa.RecordBatch.from_arrays(own + [pa.nulls(n, c.type) for c in blocks], names=names)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(begin), c.type) for c in own] + blocks, names=names)

    return _texts(docs, key, fields).mapInArrow(group, ", ".join(shape))


def each_posting(blocks: DataFrame, key: str) -> DataFrame:
    """A row for each posting of blocks: (term, key, length, tf), or with places in place of tf, ``row`` in place of key and length; further columns stay."""
    value = "places" if "places" in blocks.columns else "tf"
    numbered = "base" in blocks.columns
    more = [c for c in blocks.columns if c not in ("term", "base", "keys", "lengths", "ends", "most", "places", "tfs")]
    if value == "tf":
        values = F.col("tfs")
    else:  # cut in the block: arrays beside its postings would be copied for each of them
        before = lambda i: F.coalesce(F.get("ends", i - 1), F.lit(0))
        values = F.transform("ends", lambda e, i: F.slice("places", before(i) + 1, e - before(i)))
    each = F.explode(F.arrays_zip("keys", *([] if numbered else ["lengths"]), values.alias("values"))).alias("_p")
    rows = blocks.select("term", *(["base"] if numbered else []), *more, each)
    at = [(F.col("base") + F.col("_p.keys")).alias("row")] if numbered else [F.col("_p.keys").alias(key), F.col("_p.lengths").alias("length")]
    return rows.select("term", *at, F.col("_p.values").alias(value), *more)


def blocks_of(postings: DataFrame, key: str) -> DataFrame:
    """Blocks of postings (term, key and length, or row, and tf or places), of those that come in one batch."""
    placed, numbered = "places" in postings.columns, "row" in postings.columns
    kind = "bigint" if numbered else postings.select(key).schema[0].dataType.simpleString()
    shape = _shape(kind, placed, numbered)
    names = [s.partition(" ")[0] for s in shape]

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            codes = coded.indices.to_numpy()
            base = batch.column(1).to_numpy() >> NEAR_BITS << NEAR_BITS if numbered else codes
            order = np.lexsort((base, codes))
            codes, base = codes[order], base[order]
            begin = _blocked(codes, base)
            at = pa.array(np.append(begin, len(order)).astype(np.int32))
            *keys, values = (c.take(pa.array(order)) for c in batch.columns[1:])
            held = pa.ListArray.from_arrays
            of = [pa.array(base[begin]), held(at, pa.array((keys[0].to_numpy() - base).astype(np.int32)))] if numbered else [held(at, k) for k in keys]
            columns = [coded.dictionary.take(pa.array(codes[begin])), *of]
            columns += _flat(begin, pc.list_value_length(values).to_numpy(), values.flatten()) if placed else [held(at, values)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return postings.select("term", *(["row"] if numbered else [key, "length"]), "places" if placed else "tf").mapInArrow(group, ", ".join(shape))
