"""Ranked lexical search over shards of dual-sorted postings in wavelet trees; the highest scores, exactly.

A shard holds some documents, numbered from 0, and the postings of all their terms. A term's postings stand in order of
impact, the highest first, as the root of a wavelet tree over the document numbers: on each level a bit tells in which half
of the node's numbers a posting's document lies, and the halves keep the order. So the first posting of a node's interval
has the largest impact of the term in that range of documents, and the tree can be walked by document as well. Trees are
laid out level by level, all terms behind each other.

A search walks all its terms' trees at once from the root: a node is a range of documents with the intervals of the terms
that occur there, its bound the sum of the first impacts times the terms' weights. Nodes wait in groups of one level, the
group with the highest bound is taken first, and those below the score of rank k so far are dropped; ties are not. At a leaf
the bound is the document's score. A task keeps what it has found from shard to shard, so later shards drop more.

Terms are told apart by 64-bit hashes, so two terms could in theory count as one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, small_batches, stage, table
from .windows import chunks, word_hashes

#: Postings of a shard: it is closed with the part of the texts (windows.CHUNK_BYTES, or one longer text) that reaches them.
SHARD = 1 << 20
#: Terms of the queries that are searched together; a larger set is searched in blocks of about so many.
BLOCK_TERMS = 1 << 18
#: Nodes taken from the queue together.
GROUP = 256
#: Texts in an Arrow batch, and shards in one.
TEXTS, SHARDS = 512, 4
TOP = 20

_U = np.uint64
#: A-Z lower-cased, digits, letters and all bytes beyond ASCII kept, all else blank.
_TERM = np.full(256, 32, np.uint8)
_TERM[48:58], _TERM[97:123], _TERM[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_TERM[65:91] = np.arange(97, 123)

_COUNTS = "docs long, terms long"
_INDEX = "terms binary, sizes binary, impacts binary, bits binary, ids array<long>"
_FOUND = "query long, doc_id long, score long"


def postings(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, terms of each row, row, term, occurrences) over a text column, part by part; nulls have no terms."""
    for first, rows, data, offsets in chunks(texts):
        found, bounds, _ = word_hashes(_TERM[data], offsets)
        counts = np.diff(bounds)
        row = np.repeat(np.arange(rows, dtype=np.int32), counts)
        order = np.lexsort((found, row))
        row, found = row[order], found[order]
        new = np.ones(len(found), bool)
        new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
        at = np.flatnonzero(new)
        yield first, rows, counts, row[at], found[at], np.diff(np.append(at, len(found)))


def statistics(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all terms with repeats) over all documents."""

    def count(batches):
        n = total = 0
        for batch in batches:
            for _, rows, data, offsets in chunks(batch.column(0)):
                bounds = word_hashes(_TERM[data], offsets)[1]
                n += int((np.diff(bounds) > 0).sum())
                total += int(bounds[-1])
        yield pa.RecordBatch.from_pydict({"docs": [n], "terms": [total]})

    with small_batches(docs.sparkSession, TEXTS):
        n, total = docs.select("text").mapInArrow(count, _COUNTS).agg(F.sum("docs"), F.sum("terms")).first()
    return n or 0, total or 0


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's part of a score for weight 1: more for repeats, less in documents longer than the mean; integers below 10 ** 6."""
    m = 75 + 25 * n * n_docs // n_terms
    return (1_000_000_000 * tf // (1000 * tf + 12 * m)).astype(np.int32)


def levels_for(n_docs: int) -> int:
    """Levels of a tree over so many document numbers."""
    return max(1, int(n_docs - 1).bit_length())


def halves(starts: np.ndarray, sizes: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each posting on the next level, starts and sizes of its nodes) of a level of nodes and their bits."""
    zeros = np.zeros(len(ones) + 1, np.int64)
    np.cumsum(~ones, out=zeros[1:])
    start = np.repeat(starts, sizes)
    before = zeros[:-1] - zeros[start]
    of_node = zeros[starts + sizes] - zeros[starts]
    there = np.where(ones, np.arange(len(ones)) + np.repeat(of_node, sizes) - before, start + before)
    both = np.stack([starts, starts + of_node], 1).ravel()
    size = np.stack([of_node, sizes - of_node], 1).ravel()
    return there, both[size > 0], size[size > 0]


def build(ids: list, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> dict:
    """A shard's row of the index."""
    impact = impacts(tf, lengths[doc], n_docs, n_terms)
    order = np.lexsort((doc, -impact, term))
    doc, term, impact = doc[order], term[order], impact[order]
    at = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(at, len(term)))
    levels, bits = levels_for(len(ids)), []
    starts, counts = at, sizes
    for level in range(levels):
        ones = (doc >> (levels - 1 - level) & 1).astype(bool)
        bits.append(np.packbits(ones).tobytes())
        there, starts, counts = halves(starts, counts, ones)
        moved = np.empty_like(doc)
        moved[there] = doc
        doc = moved
    return {"terms": term[at].tobytes(), "sizes": sizes.astype(np.int32).tobytes(), "impacts": impact.tobytes(), "bits": b"".join(bits), "ids": ids}


def index(docs: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int]:
    """(the index of all documents, staged, and the number of documents with terms); the columns used are doc_id and text.

    Two passes over the texts: lengths for the impacts first. A task closes a shard with every ``shard`` postings, so one
    long document may make a larger one, and holds no more than one. A document without terms, null or empty is in a shard
    but in no list; each of several equal rows is a document; no rows give no shards.
    """
    n_docs, n_terms = statistics(docs)

    def make(batches):
        ids, parts, held, lengths = [], [], 0, []

        def closed():
            doc, term, tf = (np.concatenate(p) for p in zip(*parts, strict=True))
            row = build(ids, np.concatenate(lengths), doc, term, tf, n_docs, max(n_terms, 1))
            return pa.RecordBatch.from_pydict({k: pa.array([v], t) for (k, v), t in zip(row.items(), [pa.binary()] * 4 + [pa.list_(pa.int64())], strict=True)})

        for batch in batches:
            batch_ids = batch.column(0).to_pylist()
            for first, rows, counts, row, term, tf in postings(batch.column(1)):
                parts.append((row + len(ids), term, tf))
                lengths.append(counts)
                ids += batch_ids[first : first + rows]
                held += len(term)
                if held >= shard:
                    yield closed()
                    ids, parts, held, lengths = [], [], 0, []
        if ids:
            yield closed()

    with small_batches(docs.sparkSession, TEXTS):
        return stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, _INDEX), "shards"), n_docs


@dataclass
class Shard:
    """A shard's trees of some terms: impacts and counts of zeros on every level, and where each term's interval is."""

    ids: list
    terms: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    zeros: list = field(default_factory=list)
    impacts: list = field(default_factory=list)


def opened(row: dict, wanted: np.ndarray) -> Shard:
    """The trees of the terms in ``wanted`` (sorted): only their postings are read from the levels, and impacts put in order on each."""
    terms, sizes = np.frombuffer(row["terms"], _U), np.frombuffer(row["sizes"], np.int32).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    here = np.flatnonzero(np.isin(terms, wanted, assume_unique=True))
    size = sizes[here]
    start = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(first[here] - start, size)
    impact = np.frombuffer(row["impacts"], np.int32)[at]
    levels, total = levels_for(len(row["ids"])), int(sizes.sum())
    width = (total + 7) // 8
    shard = Shard(row["ids"], terms[here], start, start + size, [], [impact])
    starts, counts = start, size
    for level in range(levels):
        packed = np.frombuffer(row["bits"], np.uint8, width, level * width)
        ones = np.unpackbits(packed, count=total)[at].astype(bool)
        zeros = np.zeros(len(ones) + 1, np.int32)
        np.cumsum(~ones, out=zeros[1:])
        # a term's postings stay within its own segment of a level, so ``at`` holds for all of them
        there, starts, counts = halves(starts, counts, ones)
        moved = np.empty_like(impact)
        moved[there] = impact
        impact = moved
        shard.zeros.append(zeros)
        shard.impacts.append(impact)
    return shard


def search(shard: Shard, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int, object]], k: int = TOP) -> list[tuple[int, int, object]]:
    """The ``k`` best of ``best`` and this shard's documents for a query of these terms, each as (-score, null id, id) in order."""
    place = np.searchsorted(shard.terms, terms)
    known = np.flatnonzero((place < len(shard.terms)) & (weights > 0))
    known = known[shard.terms[place[known]] == terms[known]]
    if not len(known):
        return best
    place, weights = place[known], weights[known]
    bound = int((weights * shard.impacts[0][shard.starts[place]]).sum())
    least = -best[k - 1][0] if len(best) >= k else 1
    queue, made = [], 0
    if bound >= least:
        queue = [(-bound, 0, 0, np.array([bound]), np.array([0]), np.zeros(len(place), np.int64), weights, shard.starts[place], shard.ends[place])]
    while queue:
        top, _, level, bounds, nodes, of, weight, begin, end = heapq.heappop(queue)
        least = -best[k - 1][0] if len(best) >= k else 1
        if -top < least:
            break
        if level == len(shard.zeros):
            best = sorted(best + [(-int(b), shard.ids[n] is None, shard.ids[n] or 0) for b, n in zip(bounds, nodes, strict=True) if b >= least])[:k]
            continue
        live = bounds[of] >= least
        of, weight, begin, end = of[live], weight[live], begin[live], end[live]
        zeros = shard.zeros[level]
        middle = begin + zeros[end] - zeros[begin]
        left, right = middle > begin, end > middle
        child = np.concatenate([2 * nodes[of[left]], 2 * nodes[of[right]] + 1])
        weight = np.concatenate([weight[left], weight[right]])
        begin, end = np.concatenate([begin[left], middle[right]]), np.concatenate([middle[left], end[right]])
        order = np.argsort(child, kind="stable")
        child, weight, begin, end = child[order], weight[order], begin[order], end[order]
        at = np.flatnonzero(np.append(True, child[1:] != child[:-1]))
        bounds = np.add.reduceat(weight * shard.impacts[level + 1][begin], at)
        size = np.diff(np.append(at, len(child)))
        ranks = np.argsort(-bounds, kind="stable")
        ranks = ranks[bounds[ranks] >= least]
        for i in range(0, len(ranks), GROUP):
            some = ranks[i : i + GROUP]
            n = size[some]
            rows = np.arange(int(n.sum())) + np.repeat(at[some] - (np.cumsum(n) - n), n)
            made += 1
            heapq.heappush(queue, (-int(bounds[some[0]]), made, level + 1, bounds[some], child[at[some]], np.repeat(np.arange(len(some)), n), weight[rows], begin[rows], end[rows]))
    return best


def query_terms(queries: DataFrame, item: str, text: str) -> DataFrame:
    """A row a query: its number, its item, its distinct terms' hashes and their occurrences; staged, as numbers must not change."""

    def read(batches):
        for batch in batches:
            terms, counts = [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
            for first, _, _, row, term, tf in postings(batch.column(2)):
                for r, t, n in zip(row.tolist(), term.view(np.int64).tolist(), tf.tolist(), strict=True):
                    terms[first + r].append(t)
                    counts[first + r].append(n)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, lists), pa.array(counts, lists)], ["query", "item", "terms", "counts"])

    rows = queries.select(F.monotonically_increasing_id().alias("query"), F.col(item).cast("long").alias("item"), F.col(text).alias("text"))
    return stage(rows.mapInArrow(read, "query long, item long, terms array<long>, counts array<long>"), "queries")


def frequencies(shards: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """In how many documents each wanted term (sorted hashes) is: lengths of lists, from the shards' dictionaries alone."""

    def count(batches):
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, sizes in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                terms, sizes = np.frombuffer(terms, _U), np.frombuffer(sizes, np.int32)
                at = np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)
                hit = wanted[at] == terms
                total[at[hit]] += sizes[hit]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "df": pa.array(total[some])})

    found = np.zeros(len(wanted), np.int64)
    for term, df in shards.select("terms", "sizes").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        found[term] = df
    return found


def top(shards: DataFrame, n_docs: int, queries: DataFrame, item: str = "item_id", text: str = "text", k: int = TOP, block: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, doc_id, score): for each query the ``k`` documents of highest score above 0, ties to the smaller doc_id, null ids last.

    Queries are searched in blocks of about ``block`` terms, one job each; no other part of them is ever on the driver. Each
    task sends at most ``k`` documents a query. A query without terms finds nothing, each of several equal queries is searched.
    """
    spark = shards.sparkSession
    read = query_terms(queries, item, text)
    total = read.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks, found = -(-total // block), []
    for b in range(blocks):
        asked = [r for r in read.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "terms", "counts").collect() if r["terms"]]
        if not asked:
            continue
        wanted = np.unique(np.concatenate([np.array(r["terms"], np.int64).view(_U) for r in asked]))
        df = frequencies(shards, wanted)
        weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
        plan = []
        for r in asked:
            terms = np.array(r["terms"], np.int64).view(_U)
            order = np.argsort(terms)
            plan.append((r["query"], terms[order], (weight[np.searchsorted(wanted, terms)] * np.array(r["counts"], np.int64))[order]))

        def find(batches, plan=plan, wanted=wanted):
            best = {q: [] for q, _, _ in plan}
            for batch in batches:
                for row in batch.to_pylist():
                    shard = opened(row, wanted)
                    for q, terms, weights in plan:
                        best[q] = search(shard, terms, weights, best[q], k)
            rows = [(q, None if null else d, -s) for q, found in best.items() for s, null, d in found]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("query", "doc_id", "score"))})

        with small_batches(spark, SHARDS):
            found.append(stage(shards.mapInArrow(find, _FOUND), "found"))
    rows = spark.createDataFrame([], _FOUND)
    for f in found:
        rows = rows.union(f)
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    rows = rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    result = stage(rows.join(read.select("query", "item"), "query").select(F.col("item").alias(item), "rank", "doc_id", "score"), "ranked")
    discard(read, *found)
    return result


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    shards, n_docs = index(table(spark, sf_dir, "documents"))
    found = top(shards, n_docs, table(spark, sf_dir, "benchmark"))
    discard(shards)
    return found


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT k, w, count(*)::BIGINT AS tf FROM (SELECT k, unnest(w) AS w FROM d) GROUP BY ALL),
f AS (SELECT w, floor(1000 * ln((2.0 * n + 2) / (2.0 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY w, n),
q AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT q, item_id, w, count(*)::BIGINT AS qtf FROM (SELECT q, item_id, unnest(w) AS w FROM q) GROUP BY ALL),
r AS (SELECT q, item_id, k, doc_id, sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.w) * n) // l))))::BIGINT AS score
      FROM t JOIN f USING (w) JOIN p USING (w) JOIN d USING (k), s GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY rank <= {TOP}"""
