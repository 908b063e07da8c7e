"""Importance resampling towards a target: hashed word runs in buckets, a gain for each bucket, a draw by perturbed scores.

A document's features become an array of bucket numbers by higher-order functions; its weight is an aggregate over that
array of entries of one literal array of gains. Nothing is exploded to score, and only the buckets' totals are shuffled:
at most BUCKETS rows a task. Adding Gumbel noise from a hash of the id to the weights and taking the highest scores
draws without replacement, in proportion to the weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, fresh, keep_where, stage, table
from .licenses import license_words

BUCKETS = 10000
#: Words of a feature at most.
RUN = 1
SEED = 2024
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
#: Percent of the others that are drawn.
PERCENT = 10


def buckets_of(text: Column, run: int = RUN, buckets: int = BUCKETS) -> Column:
    """The bucket of every feature of a whole text, repeats included: all runs of 1 to ``run`` words, joined by one space.

    A text without words, empty or null has an empty array.
    """
    bucket = lambda w: (F.crc32(w) % buckets).cast("int")
    words = license_words(text)
    if run == 1:
        return F.transform(words, bucket)
    runs = lambda w, k: F.transform(F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>")), lambda i: bucket(F.array_join(F.slice(w, i, k), " ")))
    # the words are made once, as the one element of an array: in a lambda an expression is evaluated again for each use
    return F.transform(F.array(words), lambda w: F.concat(*[runs(w, k) for k in range(1, run + 1)]))[0]


def bucket_totals(docs: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> dict[int, int]:
    """Features in each bucket over all documents; at most ``buckets`` numbers reach the driver. No rows, no entries."""
    counts = docs.select(F.explode(buckets_of(F.col(text), run, buckets)).alias("b")).groupBy("b").count()
    return {r[0]: r[1] for r in counts.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """For each bucket, in thousandths, the logarithm of its share in the target over that in the source, each smoothed by one."""
    s_all, t_all = float(sum(source.values())), float(sum(target.values()))
    ratio = lambda b: (target.get(b, 0) + 1.0) * (s_all + buckets) / ((source.get(b, 0) + 1.0) * (t_all + buckets))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise in thousandths, from a hash of the seed and the id; a null id hashes as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST_WORDS) -> DataFrame:
    """Add n_features, weight, score, and ``eligible`` (at least ``least`` words) to every document; ``docs`` is read twice.

    Existing columns of these names are replaced, all others stay. A null or empty text has no features, weight 0 and its
    noise as score; equal rows score alike; no rows give none; without target rows all targets count as zero.
    """
    docs = docs.drop("n_features", "weight", "score", "eligible")
    (bs,) = fresh(docs, "buckets")
    found = gains(bucket_totals(docs, run=run, buckets=buckets), bucket_totals(target, run=run, buckets=buckets), buckets)
    literal = F.split(F.lit(",".join(map(str, found))), ",").cast("array<bigint>")  # constant: the optimizer makes it one literal array
    rows = docs.withColumn(bs, buckets_of(F.col("text"), run, buckets))
    weight = F.aggregate(bs, F.lit(0).cast("long"), lambda a, b: a + F.element_at(literal, b + 1))
    # of n words, there are n - k + 1 runs of k: with all k up to ``run`` that is run * n - run * (run - 1) / 2 where n >= run
    longest = sum(max(0, least - k + 1) for k in range(1, run + 1))
    rows = rows.withColumn("n_features", F.size(bs).cast("long")).withColumn("weight", weight).drop(bs)
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("eligible", F.col("n_features") >= longest)


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: each row's place from 1 in this order. ``rows`` should be staged: a range partitioning samples it first.

    Ranges are numbered on their own and moved on by the sizes of those before, so no task holds more than a range.
    """
    part, before, n = fresh(rows, "part", "before", "n")
    dealt = stage(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(n))  # a row a range: the window below holds no more
    starts = sizes.select(part, F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    local = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.withColumn(name, local).join(F.broadcast(starts), part).withColumn(name, F.col(name) + F.col(before)).drop(part, before)


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **settings) -> DataFrame:
    """The drawn documents, whole, columns as given.

    Their texts are not moved: the cut is found over ids and scores alone, and the documents are filtered by it as they are
    scored again. Of rows equal in id and score at the cut, all are taken. No rows give none.
    """
    scored = stage(keep_where(score(docs.select("doc_id", "text"), target, **settings), "eligible").select("score", "doc_id"), "scored")
    k = percent * scored.count() // 100
    ranks = ranked(scored, [F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    last = ranks.where(F.col("rank") == k).select("score", "doc_id").collect()
    discard(scored)
    if not last:
        return docs.limit(0)
    cut, cut_id = last[0]
    kept = dict(zip(docs.columns, fresh(docs.select("doc_id", "text"), *[f"_{i}" for i in range(len(docs.columns))]), strict=True))
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`").alias(n) for c, n in kept.items()]).alias("row"))
    ties = "true" if cut_id is None else f"doc_id <= {cut_id}"
    found = keep_where(score(packed, target, **settings), f"eligible and (score > {cut} or score = {cut} and {ties})")
    return found.select(*[F.col(f"row.{n}").alias(c) for c, n in kept.items()])


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' scores against the benchmark; the drawn ones have a rank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = stage(score(docs, table(spark, sf_dir, "benchmark")).drop("text"), "scored")
    k = PERCENT * scored.where("eligible").count() // 100
    # weights and counts only order rows that have one id between them
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight")]
    rank = F.when(F.col("eligible") & (F.col("place") <= k), F.col("place")).cast("long").alias("rank")
    return ranked(scored, order, "place").select("doc_id", "n_features", "weight", "score", rank)


OP12_SQL = rf"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda j: 0::UBIGINT)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT k, unnest(w) AS w FROM d),
tw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
v AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION ALL SELECT w FROM tw)),
b AS (SELECT w, (xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::UBIGINT)),
      lambda c, y: xor(t[(xor(c, y) & 255)::BIGINT + 1], c >> 8))) % {BUCKETS})::BIGINT AS b FROM v, bits),
s AS (SELECT b, count(*)::DOUBLE AS s FROM dw JOIN b USING (w) GROUP BY b),
t AS (SELECT b, count(*)::DOUBLE AS t FROM tw JOIN b USING (w) GROUP BY b),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (b), n),
u AS (SELECT k, sum(gain)::BIGINT AS weight FROM dw JOIN b USING (w) JOIN g USING (b) GROUP BY k),
h AS (SELECT d.k, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE AS h FROM d LEFT JOIN u USING (k)),
c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score, n_features >= {LEAST_WORDS} AS ok FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY score DESC, doc_id NULLS LAST, n_features DESC, weight DESC) AS place FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND place <= {PERCENT} * (SELECT count(*) FROM c WHERE ok) // 100 THEN place END AS rank FROM r"""
