"""N-gram Jaccard join: documents whose sets of word shingles are alike, found through R-trees of group counts.

Sets that link share a rare shingle, so the sets of each such shingle, its posting, are one index: a tree over their
points, the counts of their shingles by group of hashes. A pair is proposed where summed minima of two points allow a link.

1. Every posting proposes pairs and keeps a spanning forest of them, so it sends fewer rows than it has sets. Postings
   that list the same sets are one. What the forests connect is a cluster: every link is inside one.
2. Each set's shingles go once to its cluster, where a tree proposes pairs again and these are verified exactly;
   the cluster, too, sends only a spanning forest, of verified links.
A posting or cluster of more than DEAL sets is dealt to several tasks. What its tasks have joined is then known, and
only sets outside the largest group so found still visit all the other tasks' sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows as W
from .common import discard, fresh, remove_path, small_batches, stage, table

SPAN = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Coordinates of a point: shingles are hashed into so many groups and counted.
GROUPS = 64
#: Points in a leaf of the tree, and leaves in a node above.
LEAF = 16
#: Sets of a posting or cluster that one task compares with one another; more are dealt.
DEAL = 256
#: Bytes of text for each group of postings, and of clusters, that a task takes at once, and the least number of groups.
GROUP_BYTES, LEAST_GROUPS = 1 << 20, 64
#: Cells of a sketch's row at most, as a power of two: 128 MB a row in each worker, which texts of 6 GB need. With cells for all
#: shingles few are taken for repeated that are not; with a quarter of that, nearly all of them are, and all sets go on whole.
SKETCH_BITS = 30

_SETS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("tokens", pa.binary()), ("point", pa.binary()), ("prefix", pa.list_(pa.int64()))])
_SETS_SQL = "doc_id long, mark long, n_shingles long, node binary, tokens binary, point binary, prefix array<long>"


def _sets(texts: pa.Array, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, hashes): the sorted hashes of the distinct shingles of some rows; lower-cased in A-Z."""
    for at, count, data, offsets in W.chunks(texts):
        words, bounds, _ = W.word_hashes(data, offsets, lower=True)
        h, _, row, _ = W.window_hashes(words, bounds, None, span, short=True)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield at, np.searchsorted(row[new], np.arange(count + 1)), h[new]


def _hashes(span: int):
    def found(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, _, h in _sets(texts, span):
            yield h

    return found


def least_overlap(a, b, percent: int = PERCENT):
    """The least intersection of linked sets of these sizes: percent / (100 + percent) of their sum, rounded up."""
    return -(-percent * (a + b) // (100 + percent))


def point(tokens: np.ndarray) -> np.ndarray:
    """Counts by group. 255 stands for any larger count."""
    return np.minimum(np.bincount((tokens >> np.uint64(20)).astype(np.int64) % GROUPS, minlength=GROUPS), 255).astype(np.uint8)


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of points: never below the intersection."""
    least = np.minimum(a, b)
    out = least.sum(-1, dtype=np.int64)
    big = (least == 255).any(-1)
    return np.where(big, np.int64(1) << 40, out) if np.any(big) else out


def _mark():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _described(s: np.ndarray, rare: np.ndarray, length: int) -> dict:
    """What a set that may link brings to the join; ``length`` is its prefix's."""
    order = np.lexsort((s, rare))[:length]
    tokens = s[rare > 0]
    return {"tokens": tokens.tobytes(), "point": point(tokens).tobytes(), "prefix": s[order[rare[order] > 0]].view(np.int64)}


def sets_of(docs: DataFrame, span: int = SPAN, percent: int = PERCENT) -> DataFrame:
    """(doc_id, mark, n_shingles, node, tokens, point, prefix) of each document, staged.

    mark is a hash of the text, which tells rows of one doc_id apart. node is a digest of the set, null without words.
    Only shingles that the sketch estimates in two documents can be in an intersection; where these are too few for
    a link, the rest is null. tokens are the estimated repeated shingles; prefix are those of them among the first
    n - least overlap + 1 shingles in an order that is rare first, so that linked sets share one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"))
    bits, _ = W.sketch_size(W.text_bytes(rows), SKETCH_BITS)
    with small_batches(spark):
        path = W.sketch(rows, bits, _hashes(span))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.estimates(path, bits)
        for batch in batches:
            ids, marks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for at, bounds, h in _sets(batch.column(0), span):
                out: list[dict] = []
                classes = known.classes(h)
                shared = np.concatenate([[0], np.cumsum(classes > 0)])
                for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False), at):
                    n = b - a
                    row = dict.fromkeys(_SETS.names) | {"doc_id": ids[i], "mark": marks[i], "n_shingles": n}
                    if n:
                        row["node"] = hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest()
                        need = -(-percent * n // 100)
                        if shared[b] - shared[a] >= need:
                            row |= _described(h[a:b], classes[a:b], n - need + 1)
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, _SETS)

    with small_batches(spark):
        done = stage(rows.mapInArrow(make, _SETS_SQL), "sets")
    remove_path(spark, path)
    return done


def postings(sets: DataFrame, deal: int = DEAL) -> DataFrame:
    """(key, deals, node, n, point): the sets of each prefix token that two sets or more have, staged.

    Tokens that list the same sets, told by two sums of hashes over them, are one. deals is over how many tasks a
    posting is dealt.
    """
    described = sets.where("prefix is not null").groupBy("node")
    tokens = stage(described.agg(F.first("prefix").alias("p")).select("node", F.explode("p").alias("token")), "tokens")
    listed = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("m > 1")
    one = listed.groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token", "m")
    points = described.agg(F.first("n_shingles").cast("int").alias("n"), F.first("point").alias("point"))
    found = stage(tokens.join(one, "token").join(points, "node").select(F.col("token").alias("key"), _deals(F.col("m"), deal).alias("deals"), "node", "n", "point"), "postings")
    discard(tokens)
    return found


def _deals(count, deal: int):
    return F.ceil(count / deal).cast("int")


class Tree:
    """A packed R-tree of points: sorted by size and coordinates, LEAF points to a leaf, LEAF leaves to a node.

    A box keeps the largest coordinates and the sizes of what is below. A query visits a box only if the bound
    with the box's largest coordinates reaches what the smallest size in reach needs.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.points, self.sizes, self.percent = points, sizes, percent
        self.levels = []
        high, low, top = points, sizes, sizes
        while len(high) > LEAF:
            cuts = np.arange(0, len(high), LEAF)
            high, low, top = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(top, cuts)
            self.levels.append((high, low, top))

    def _reach(self, q: np.ndarray, b: np.ndarray, high: np.ndarray, low: np.ndarray, top: np.ndarray) -> np.ndarray:
        n = self.sizes[q]
        near = (top[b] * 100 >= n * self.percent) & (low[b] * self.percent <= n * 100)
        q, b = q[near], b[near]
        out = np.zeros(len(near), bool)
        ok = np.empty(len(q), bool)
        for at in range(0, len(q), 1 << 16):
            s = slice(at, at + (1 << 16))
            least = least_overlap(self.sizes[q[s]], np.maximum(low[b[s]], -(-self.sizes[q[s]] * self.percent // 100)), self.percent)
            ok[s] = bound(self.points[q[s]], high[b[s]]) >= least
        out[near] = ok
        return out

    def pairs(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, earlier point) whose bound allows a link, for the points given by their places."""
        n = len(self.points)
        levels = [(self.points, self.sizes, self.sizes), *self.levels]
        width = LEAF ** (len(levels) - 1)
        count = len(levels[-1][0])
        q, b = np.repeat(queries, count), np.tile(np.arange(count), len(queries))
        for depth in range(len(levels) - 1, -1, -1):
            ahead = b * width < q  # only boxes with a point before the query
            q, b = q[ahead], b[ahead]
            ok = self._reach(q, b, *levels[depth])
            q, b = q[ok], b[ok]
            if depth:
                below = len(levels[depth - 1][0])
                q, b = np.repeat(q, LEAF), (b[:, None] * LEAF + np.arange(LEAF)).ravel()
                q, b = q[b < below], b[b < below]
                width //= LEAF
        assert len(b) == 0 or b.max() < n
        return q, b


_EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _allowed(rows: pa.Table, keys: list[str], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, earlier row, bound) of the rows of one key whose bound allows a link; ``rows`` are sorted.

    All earlier rows of a query come in one block. A key with few rows is one leaf: such keys are scanned
    together, at each distance at once. Every other key has a tree of its own.
    """
    n = rows.num_rows
    if not n:
        return
    points = np.frombuffer(rows.column("point").combine_chunks().cast(pa.binary(GROUPS)).buffers()[1], np.uint8, n * GROUPS).reshape(n, GROUPS)
    sizes = rows.column("n").to_numpy().astype(np.int64)
    same = np.ones(n - 1, bool)
    for k in keys:
        v = rows.column(k).to_numpy()
        same &= v[1:] == v[:-1]
    cuts = np.concatenate([[0], np.flatnonzero(~same) + 1, [n]])
    count = np.diff(cuts)
    begin = np.repeat(cuts[:-1], count)
    place = np.arange(n) - begin
    small = np.repeat(count <= LEAF, count)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for far in range(1, LEAF):
        q = np.flatnonzero(small & (place >= far))
        q = q[sizes[q - far] * 100 >= sizes[q] * percent]
        for part in np.array_split(q, max(1, len(q) >> 16)):
            score = bound(points[part], points[part - far])
            ok = score >= least_overlap(sizes[part], sizes[part - far], percent)
            found.append((part[ok], part[ok] - far, score[ok]))
    yield tuple(np.concatenate(x) for x in zip(*found, strict=True))
    for a, m in zip(cuts[:-1][count > LEAF].tolist(), count[count > LEAF].tolist(), strict=True):
        tree = Tree(points[a : a + m], sizes[a : a + m], percent)
        for at in range(0, m, 256):
            q, b = tree.pairs(np.arange(at, min(at + 256, m)))
            score = np.concatenate([bound(tree.points[q[i : i + 65536]], tree.points[b[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0, np.int64)])
            yield q + a, b + a, score


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining each a with its b; a label is the place of a row that has itself as its label."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := label[label], label):
            label = up


def _verifier(rows: pa.Table, percent: int):
    """A function of places (q, b) that tells which pairs of sets link, by their whole intersections."""
    column = rows.column("tokens").combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) // 8
    tokens = np.frombuffer(column.buffers()[2], np.uint64)[offsets[0] : offsets[-1]]
    known, ids = np.unique(tokens, return_inverse=True)
    counts, first = np.diff(offsets), offsets[:-1] - offsets[0]
    # Tokens of a row are sorted, so these numbers are.
    every = np.repeat(np.arange(len(counts)) * len(known), counts) + ids
    n = rows.column("n").to_numpy().astype(np.int64)

    def links(q: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q), bool)
        ends = np.cumsum(counts[q])
        at = 0
        while at < len(q):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + (1 << 19), "right")))
            k = counts[q[at:stop]]
            begin = np.cumsum(k) - k
            mine = np.repeat(first[q[at:stop]] - begin, k) + np.arange(k.sum())
            want = np.repeat(b[at:stop] * len(known), k) + ids[mine]
            hit = every[np.minimum(np.searchsorted(every, want), len(every) - 1)] == want
            both = np.add.reduceat(hit.astype(np.int64), begin)
            out[at:stop] = 100 * both >= percent * (n[q[at:stop]] + n[b[at:stop]] - both)
            at = stop
        return out

    return links


def _joined(percent: int):
    """For one group of rows (key, cell, label, n, point and maybe side, tokens): the labels that its pairs join, as a forest.

    Pairs are of one key and cell and, where there are sides, of two sides. With tokens they are verified, the most
    promising of each set first, and pairs that are joined by then are not.
    """

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        W.release()
        rows = rows.sort_by([(k, "ascending") for k in ("key", "cell", "n", "point", "label")])
        if not rows.num_rows:
            return _EDGES.empty_table()
        names = rows.column("label").combine_chunks().dictionary_encode()
        of = names.indices.to_numpy()
        side = rows.column("side").to_numpy(zero_copy_only=False) if "side" in rows.column_names else None
        links = _verifier(rows, percent) if "tokens" in rows.column_names else None
        label = np.arange(len(names.dictionary))
        for q, b, score in _allowed(rows, ["key", "cell"], percent):
            if side is not None:
                keep = side[q] != side[b]
                q, b, score = q[keep], b[keep], score[keep]
            if links is None:
                label = unite(label, of[q], of[b])
                continue
            while True:
                keep = label[of[q]] != label[of[b]]
                q, b, score = q[keep], b[keep], score[keep]
                if not len(q):
                    break
                order = np.lexsort((-score, q))
                best = order[np.concatenate([[True], q[order][1:] != q[order][:-1]])]
                ok = links(q[best], b[best])
                label = unite(label, of[q[best[ok]]], of[b[best[ok]]])
                rest = np.ones(len(q), bool)
                rest[best] = False
                q, b, score = q[rest], b[rest], score[rest]
        far = np.flatnonzero(label != np.arange(len(label)))
        return pa.Table.from_arrays([names.dictionary.take(pa.array(far)), names.dictionary.take(pa.array(label[far]))], schema=_EDGES)

    return join


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all linked nodes, staged: label is the smallest node reachable. ``links`` (a, b) is staged, and discarded.

    Large-star and small-star rounds until nothing changes, each written to the shared folder: neighbours above
    a node are hung to its smallest neighbour, then the others. Each key's smallest neighbour is found with
    partial sums and joined back, so a hub is never gathered.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    discard(links)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = stage(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, stage(hung.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct(), "edges")
        discard(before, large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            found = stage(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "labels")
            discard(edges)
            return found
        state = tuple(now)


def _edges(rows: DataFrame, groups: int, percent: int) -> DataFrame:
    """What the cells of ``rows`` join, staged: cells are dealt to groups, and a task takes a group at once."""
    grouped = rows.withColumn("group", F.pmod(F.xxhash64("key", "cell"), F.lit(groups)).cast("int")).groupBy("group")
    return stage(grouped.applyInArrow(_joined(percent), "a binary, b binary"), "edges")


def linked(rows: DataFrame, groups: int, percent: int = PERCENT, deal: int = DEAL, dealings: int = 2) -> DataFrame:
    """(node, label), staged, of the nodes that pairs join: all that share a key, as the points or the tokens allow.

    ``rows`` are (key, deals, node, n, point and maybe tokens) and may be read twice. A key's rows are dealt to
    tasks ``dealings`` times. After that, of a key with several deals, those outside its largest joined group visit
    all of its deals, also dealt; no key's rows ever meet in one task, and where little is left apart, little travels.
    """
    carried = [c for c in ("n", "point", "tokens") if c in rows.columns]
    turns = F.sequence(F.lit(0), F.when(F.col("deals") > 1, dealings - 1).otherwise(0))
    turned = rows.withColumn("turn", F.explode(turns))
    cell = (F.pmod(F.xxhash64("node", "key", "turn"), F.col("deals")) + F.col("turn") * F.col("deals")).cast("long")
    labels = components(_edges(turned.select("key", cell.alias("cell"), F.col("node").alias("label"), *carried), groups, percent))
    hot = rows.where("deals > 1")
    named = hot.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    shares = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    home = shares.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("home"), (F.sum("c") - F.max("c")).alias("away")).where("away > 0")
    home = stage(home, "homes")
    if home.isEmpty():
        discard(home)
        return labels
    met = named.join(F.broadcast(home) if home.count() <= 4096 else home, "key").withColumn("visits", _deals(F.col("away"), deal).cast("long"))
    across = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)
    stay = met.withColumn("deal", F.pmod(F.xxhash64("node", "key"), F.col("deals"))).withColumn("visit", F.explode(across("visits")))
    go = met.where("label <> home").withColumn("visit", F.pmod(F.xxhash64("node", "key", F.lit(1)), F.col("visits"))).withColumn("deal", F.explode(across("deals")))
    both = stay.withColumn("side", F.lit(False)).unionByName(go.withColumn("side", F.lit(True)))
    more = components(_edges(both.select("key", (F.col("deal") * F.col("visits") + F.col("visit")).alias("cell"), "label", "side", *carried), groups, percent))
    up = more.select(F.col("node").alias("label"), F.col("label").alias("up"))
    alone = more.join(labels, "node", "left_anti")
    lifted = labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")).unionByName(alone)
    found = stage(lifted, "labels")
    discard(labels, home, more)
    return found


def linked_nodes(sets: DataFrame, total: int, percent: int = PERCENT, deal: int = DEAL) -> DataFrame:
    """(node, label), staged, of all nodes with a link; ``total`` is the bytes of all texts."""
    groups = max(LEAST_GROUPS, total // GROUP_BYTES)
    posts = postings(sets, deal)
    clusters = linked(posts, groups, percent, deal)
    discard(posts)
    sizes = clusters.groupBy("label").agg(_deals(F.count(F.lit(1)), deal).alias("deals"))
    cluster = clusters.join(sizes, "label").select("node", F.xxhash64("label").alias("key"), "deals")
    whole = sets.where("prefix is not null").groupBy("node").agg(F.first("n_shingles").cast("int").alias("n"), F.first("point").alias("point"), F.first("tokens").alias("tokens"))
    found = linked(whole.join(cluster, "node"), groups, percent, deal)
    discard(clusters)
    return found


def near_duplicates(docs: DataFrame, span: int = SPAN, percent: int = PERCENT) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) of each document, over whole texts.

    A set holds the distinct ``span``-word shingles, or with fewer words the whole sequence. component_id is the
    smallest doc_id reachable by links, itself included; documents without words are linked with nothing, not
    with one another either. Equal sets are one node, so copies never meet in pairs. A null doc_id takes part,
    and is a component's id only where it has no other. Repeated rows give repeated rows; no rows give none.
    Other columns are not carried; mark is a hash of the text.
    """
    sets = sets_of(docs, span, percent)
    rows = sets.select("doc_id", "mark", "n_shingles", "node")
    labels = linked_nodes(sets, W.text_bytes(docs.select(F.col("text").cast("string").alias("text"))), percent)
    label = F.coalesce("label", "node").alias("label")
    firsts = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").select("node", "least", label)
    ids = firsts.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = firsts.join(ids, "label").select("node", "component_id")
    met = rows.join(by_node, "node", "left")
    return met.select("doc_id", "mark", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, span: int = SPAN, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest doc_id; columns as given.

    Rows that repeat the kept doc_id of a group are kept with it, as is a group in which no row has an id.
    Documents without words are all kept.
    """
    mark, id_, mark_ = fresh(docs, "mark", "id", "mark2")
    found = near_duplicates(docs, span, percent)
    drop = found.where("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias(id_), F.col("mark").alias(mark_)).distinct()
    rows = docs.withColumn(mark, _mark())
    return rows.join(drop, rows["doc_id"].cast("long").eqNullSafe(drop[id_]) & (rows[mark] == drop[mark_]), "left_anti").select(*docs.columns)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("mark")


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS t FROM d),
n AS (SELECT doc_id, len(t)::BIGINT AS n FROM s),
x AS (SELECT doc_id, md5(unnest(t)) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * k >= 80 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON n.doc_id = m.a
"""
