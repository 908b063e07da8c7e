"""Queries over joins by bins, strongly connected components and approximate vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ann, catalog, graph, ranges
from ..sources import sqlite, tables
from .registry import query

_SPANS = "SELECT s_suppkey, s_acctbal - 40 * (s_suppkey % 9) AS lo, s_acctbal + 300 * (s_suppkey % 4) AS hi FROM supplier"


@query(f"SELECT s_suppkey, count(*) AS n, round(sum(c_acctbal), 2) AS total, min(c_custkey) AS first FROM customer JOIN ({_SPANS}) ON c_acctbal >= lo AND c_acctbal < hi GROUP BY s_suppkey")
def range_join_binned(spark, sf_dir):
    """Customers whose balance lies in a supplier's range; ranges are of many widths, some empty."""
    s = tables.load(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - 40 * (F.col("s_suppkey") % 9)).alias("lo"), (F.col("s_acctbal") + 300 * (F.col("s_suppkey") % 4)).alias("hi"))
    c = tables.load(spark, sf_dir, "customer").select("c_acctbal", F.lit(1).cast("long").alias("n"), F.col("c_acctbal").alias("total"), F.col("c_custkey").alias("first"))
    met = ranges.range_sums(c, s, "c_acctbal", "lo", "hi", ["s_suppkey"], ("n", "total"), ("first",))
    return met.select("s_suppkey", "n", F.round("total", 2).alias("total"), "first")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events), w AS (SELECT user_id, event_id, t - 3600 * (event_id % 50) AS lo, t AS hi FROM e)
SELECT w.event_id, count(*) AS n FROM w JOIN e ON e.user_id = w.user_id AND e.t >= w.lo AND e.t < w.hi GROUP BY w.event_id""")
def interval_join_binned(spark, sf_dir):
    """For each event, its user's events in a span of its own before it: bins within users."""
    e = tables.load(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    w = e.select("user_id", "event_id", (F.col("t") - 3600 * (F.col("event_id") % 50)).alias("lo"), F.col("t").alias("hi"))
    return ranges.range_join(e.select("user_id", "t"), w, "t", "lo", "hi", ["user_id"]).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH a AS ({_SPANS}), b AS (SELECT p_partkey, p_retailprice - p_size AS lo2, p_retailprice + 5 * p_size AS hi2 FROM part) SELECT s_suppkey, count(*) AS n, min(p_partkey) AS first FROM a JOIN b ON lo < hi2 AND lo2 < hi AND lo < hi AND lo2 < hi2 GROUP BY s_suppkey""")
def overlap_join_binned(spark, sf_dir):
    """Suppliers' ranges and parts' ranges that overlap."""
    s = tables.load(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - 40 * (F.col("s_suppkey") % 9)).alias("lo"), (F.col("s_acctbal") + 300 * (F.col("s_suppkey") % 4)).alias("hi"))
    p = tables.load(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") - F.col("p_size")).alias("lo2"), (F.col("p_retailprice") + 5 * F.col("p_size")).alias("hi2"))
    p = p.select("lo2", "hi2", F.lit(1).cast("long").alias("n"), F.col("p_partkey").alias("first"))
    return ranges.overlap_sums(s, p, "lo", "hi", ["s_suppkey"], ("n",), ("first",))


_TRADE = """t AS (SELECT c_nationkey AS k, 'c' || o_custkey AS c, 's' || l_suppkey AS s, l_linenumber AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey),
e AS (SELECT DISTINCT CASE WHEN n % 2 = 1 THEN c ELSE s END AS src, CASE WHEN n % 2 = 1 THEN s ELSE c END AS dst FROM t), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""


@query(f"""WITH RECURSIVE {_TRADE}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON b = src)
SELECT node, coalesce((SELECT max(x.b) FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a = node AND x.b >= node), node) AS component FROM v""")
def graph_components(spark, sf_dir):
    """Strongly connected components of customers and suppliers of one nation: odd lines lead one way, even ones back."""
    li, o, c, s = (tables.load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    t = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).where("c_nationkey = s_nationkey")
    a, b = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    odd = F.col("l_linenumber") % 2 == 1
    return graph.components(t.select(F.when(odd, a).otherwise(b).alias("src"), F.when(odd, b).otherwise(a).alias("dst")))


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame, int]:
    e = tables.load(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return e, asked, len(e.select("embedding").first()[0])


@query()
def vector_lsh(spark, sf_dir):
    """The ten nearest of each hundredth vector by buckets, with each query's recall against a scan; buckets propose, so SQL has no twin."""
    e, asked, size = _vectors(spark, sf_dir)
    index = ann.buckets(e, "vec_id", "embedding", size)
    near = ann.search(index, e, asked, "vec_id", "embedding", "query_id", size)
    scan = ann.exact(e, asked, "vec_id", "embedding", "query_id").select("query_id", "vec_id", F.lit(1).alias("hit"))
    met = near.join(scan, ["query_id", "vec_id"], "left")
    recall = F.sum(F.coalesce("hit", F.lit(0))) / F.lit(10)
    return met.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("string")), ",").alias("found"), recall.alias("recall"))


@query("SELECT count(*) AS queries, true AS recalled FROM embeddings WHERE vec_id % 100 = 0")
def vector_lsh_recall(spark, sf_dir):
    """Whether the mean recall of the ten nearest is at least 0.9."""
    return vector_lsh(spark, sf_dir).agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("recalled"))


def _files(spark, sf_dir) -> str:
    """The orders as SQLite files in the shared folder; made where the table's present files have none yet."""
    path = f"{tables.work_folder(spark)}/sqlite-{tables.version(spark, sf_dir, 'orders')}"
    if not tables.exists(spark, f"{path}/part-00000.sqlite"):
        rows = tables.load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderpriority")
        sqlite.write(rows.repartitionByRange(4, "o_orderkey"), path, "orders", "o_orderkey", ("o_custkey",))
    return path


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS first FROM orders WHERE o_totalprice > 100000 AND o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey IS NOT NULL GROUP BY o_orderstatus")
def sqlite_orders(spark, sf_dir):
    """A table of SQLite files, read by ranges of row ids; the filters are SQLite's."""
    rows = sqlite.read(spark, _files(spark, sf_dir), "orders").where("o_totalprice > 100000 and o_orderpriority in ('1-URGENT', '5-LOW') and o_custkey is not null")
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("first"))


@query("SELECT * FROM (VALUES ('orders', 1, 'o_orderkey', 'bigint', true), ('orders', 2, 'o_custkey', 'bigint', false), ('orders', 3, 'o_orderstatus', 'string', false), ('orders', 4, 'o_totalprice', 'double', false), ('orders', 5, 'o_orderdate', 'string', false), ('orders', 6, 'o_orderpriority', 'string', false)) v(\"table\", ordinal, \"column\", type, primary_key)")
def sqlite_describe(spark, sf_dir):
    """What the files themselves say of a table's columns and key."""
    return catalog.describe(spark, catalog.sqlite_database("s", _files(spark, sf_dir)), "orders").select("table", "ordinal", "column", "type", "primary_key")
