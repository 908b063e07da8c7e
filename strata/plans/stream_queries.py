"""Streams with state and an index that a stream keeps, over replays of the events and documents with late and repeated files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import indexing
from ..operators.store import Store
from ..sources import tables
from ..streaming import indexed, state, streams
from .knowledge import NOW, _n_chunks
from .registry import AS_OF, bm25_sql, query


def _events(spark, sf_dir) -> tuple[DataFrame, str]:
    from .queries import _replay

    events, folder = _replay(spark, sf_dir)
    return events, folder


@query("SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n FROM events")
def stream_exact_cap(spark, sf_dir):
    """At each event, its user's events in the 24 hours up to it; files come late and twice."""
    from .queries import _LATE, _NOBODY, _ntz

    events, folder = _events(spark, sf_dir)
    found = state.last_hours(events, "user_id", "event_id", "ts", 24, _LATE)
    return _ntz(streams.run_now(found, f"{folder}-out", f"{folder}-at").where(F.col("user_id") != _NOBODY))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 4 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM (SELECT user_id, ts, max(fresh) AS fresh, count(*) AS k FROM g GROUP BY ALL)), c AS (SELECT b.user_id, b.no, e.ts FROM b JOIN events e ON e.user_id = b.user_id AND e.ts = b.ts)
SELECT user_id, min(ts) AS begin, max(ts) AS finish, count(*) AS n, CASE WHEN count(*) > 2 THEN 'poll' ELSE 'changes' END AS action FROM c GROUP BY user_id, no""")
def stream_bursts(spark, sf_dir):
    """Bursts of a user's events; those of more than two ask for a poll."""
    from .queries import _LATE, _NOBODY, _ntz

    events, folder = _events(spark, sf_dir)
    found = state.bursts(events, "user_id", "event_id", "ts", 4 * 3600, 2, _LATE)
    return _ntz(streams.run_now(found, f"{folder}-out", f"{folder}-at").where(F.col("user_id") != _NOBODY))


@query(f"SELECT user_id, round(sum(value * pow(0.5, greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts), 0) / 86400e6 / 30)), 6) AS total FROM events GROUP BY user_id")
def stream_decay(spark, sf_dir):
    """Decayed sums kept from a stream, whatever order its files come in: what decayed_sum gives."""
    ev = tables.load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    folder, schema = streams.replayed(ev, 4, F.pmod(F.dayofyear("ts") * 4 / 31, F.lit(4)).cast("int"))
    once = streams.deduplicated(streams.watch(spark, folder, schema, 1), ["event_id"], "ts", "90 days")
    streams.decayed_stream(once, f"{folder}-sums", "user_id", "ts", "value", 30.0, f"{folder}-at")
    return streams.decayed_total(spark, f"{folder}-sums", "user_id", AS_OF, 30.0).withColumn("total", F.round("total", 6))


_FINAL = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'license renewed' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0"


@query(f"""WITH f AS ({_FINAL}), c AS (SELECT DISTINCT md5(text) AS content_hash, text FROM f), k AS (SELECT {_n_chunks("SELECT text FROM c")} AS n),
x AS (SELECT content_hash, unnest(list_transform(range(1, greatest(1, ceil((len(l) - 10) / 70.0)::INT * 70 - 70 + 1) + 1, 70), lambda s: left(array_to_string(list_slice(l, s, s + 79), chr(10)), 6000))) AS text FROM (SELECT content_hash, string_split_regex(text, '\\r?\\n') AS l FROM c)),
y AS (SELECT content_hash, text, row_number() OVER () AS id FROM x WHERE regexp_matches(text, '\\S')), b AS ({bm25_sql("y", "id", {"text": 1.0}, T.query_terms("renewed license"), False, None, 9)}),
s AS (SELECT content_hash, max(score) AS score FROM b JOIN y USING (id) GROUP BY 1)
SELECT v.kept, doc_id::VARCHAR AS path, md5(text) AS content_hash, round(score, 6) AS score, n AS chunks FROM f LEFT JOIN s ON s.content_hash = md5(f.text), k, (VALUES ('stream'), ('batch')) v(kept)""")
def stream_index(spark, sf_dir):
    """An index kept by a stream whose files come late and twice, and by one run over the last state: the same files, chunks and scores."""
    d = tables.load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    edited = d.where("doc_id % 5 = 0").withColumn("text", F.concat("text", F.lit("\nlicense renewed")))
    gone = d.where("doc_id % 7 = 0").withColumn("text", F.lit(None).cast("string"))
    rows = None
    for no, one in enumerate((d, edited, gone)):
        one = one.withColumn("no", F.lit(no))
        rows = one if rows is None else rows.unionByName(one)
    at = F.timestamp_seconds(F.col("no") * 60)
    changes = rows.select(F.col("doc_id").cast("string").alias("path"), at.alias("at"), F.col("text").isNull().alias("deleted"), F.length("text").cast("long").alias("size"), at.alias("modified"), F.col("lang").alias("language"), F.md5("text").alias("content_hash"), "text", "no")
    folder, schema = streams.replayed(changes, 3, F.col("no"), files=None)
    files = sum(name.endswith(".parquet") for name, *_ in tables.listing(spark, folder))
    words = lambda contents: (indexing.extract(contents)[0], indexing.extract(contents)[1].withColumn("tokens", F.lit("")))  # noqa: E731  the texts alone are searched
    kept, whole = (Store.at(spark, f"{folder}-{n}") for n in ("kept", "whole"))
    indexed.maintain(streams.watch(spark, folder, schema, max(1, files // 4)).drop("no"), kept, "r", "/docs", f"{folder}-at", NOW, searchable=True, extraction=words)
    last = changes.where("(no = 0 and int(path) % 5 <> 0 or no = 1) and int(path) % 7 <> 0")
    indexing.index_run(whole, "r", "/docs", last, NOW, searchable=True, extraction=words)
    out = None
    for store, name in ((kept, "stream"), (whole, "batch")):
        _, chunks = indexing.text_indexes(store)
        scores = chunks.bm25("renewed license", None, prefix_last=False)
        best = scores.groupBy(F.split_part("chunk_id", F.lit(":"), F.lit(1)).alias("content_hash")).agg(F.round(F.max("score"), 6).alias("score"))
        found = store.read("files").join(best, "content_hash", "left").select(F.lit(name).alias("kept"), "path", "content_hash", "score", F.lit(chunks.totals()[0]).alias("chunks"))
        out = found if out is None else out.unionByName(found)
    return out
