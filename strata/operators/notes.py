"""Notes about files: remembering, recalling with staleness, usefulness, pins, and feedback on search hits.

Each function takes tables and returns what a table becomes, so a caller may write it to a store or go on with it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables
from . import indexing, search
from .inverted import Index

USEFUL_BOOST = 0.1


#: The fields that are searched, each with weight 1.
FIELDS = ("note", "tokens")


def file_stem(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def remember(inputs: DataFrame, files: DataFrame, as_of: dt.datetime, first_id: int = 1) -> DataFrame:
    """Rows of notes for inputs (seq, repo_id, note, files, tags): redacted, normalised, pinned to their files' present hashes.

    ids follow ``seq``; a file that the index does not have is pinned to an empty hash.
    """
    note = T.redact(F.col("note"))
    rows = inputs.select("seq", "repo_id", note.alias("note"), T.normalize_files(F.col("files")).alias("files"), T.normalize_tags(F.col("tags")).alias("tags"))
    tokens = T.split_identifiers(F.concat_ws(" ", "note", F.array_join(F.transform("files", file_stem), " ")))
    now = F.lit(as_of).cast("timestamp")
    rows = tables.numbered(rows, ["seq"], "id", first_id).withColumn("tokens", tokens).withColumn("useful_count", F.lit(0).cast("long")).withColumn("created_at", now).withColumn("updated_at", now)
    return _pinned(rows, files).drop("seq")


def _pinned(notes: DataFrame, files: DataFrame) -> DataFrame:
    """``notes`` with the present hash of each of their files, in order."""
    pins = notes.select("id", "repo_id", F.posexplode("files").alias("place", "path"))
    met = pins.join(files.select("repo_id", "path", "content_hash"), ["repo_id", "path"], "left")
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("content_hash", F.lit("")).alias("h")))), lambda x: x["h"])
    found = met.groupBy("id").agg(hashes.alias("file_hashes"))
    return notes.drop("file_hashes").join(found, "id", "left").withColumn("file_hashes", F.coalesce("file_hashes", F.array().cast("array<string>")))


def repin(notes: DataFrame, files: DataFrame, ids: list[int], as_of: dt.datetime) -> DataFrame:
    """Notes with the pins of these ids made anew."""
    mine = notes.where(F.col("id").isin(ids))
    fresh = _pinned(mine, files).withColumn("updated_at", F.lit(as_of).cast("timestamp"))
    return notes.where(~F.col("id").isin(ids)).unionByName(fresh.select(*notes.columns))


def forget(notes: DataFrame, repo_id: str, note_id: int) -> DataFrame:
    """Notes without one."""
    return notes.where(~((F.col("repo_id") == repo_id) & (F.col("id") == note_id)))


def mark_notes_useful(notes: DataFrame, ids: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Notes with each count raised by how often ``ids`` (id) names it."""
    votes = ids.groupBy("id").agg(F.count(F.lit(1)).alias("_votes"))
    met = notes.join(votes, "id", "left")
    hit = F.col("_votes").isNotNull()
    return met.select(*[{"useful_count": F.col("useful_count") + F.coalesce("_votes", F.lit(0)), "updated_at": F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))}.get(c, F.col(c)).alias(c) for c in notes.columns])


def mark_hits_useful(query: DataFrame, hits: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rows of search_feedback for hits (target) of a remembered query (repo_id, query_tokens, hits).

    A target that names a hit, by id or path, gives a row for both; another gives one for itself.
    """
    asked = query.select("repo_id", "query_tokens")
    return mark_rows_useful(asked, query.select(F.explode("hits").alias("h")).select("h.id", "h.path"), hits, as_of)


def mark_rows_useful(query: DataFrame, shown: DataFrame, hits: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The same where the hits of the query (repo_id, query_tokens), which is one row, are rows (id, path) of their own: any number.

    Names are looked up by equal joins, ids and paths in one; of several hits of a name that of the least id counts.
    """
    pair = F.struct(F.col("id").alias("i"), F.col("path").alias("p"))
    names = shown.select(F.explode(F.array_distinct(F.array("id", "path"))).alias("target"), "id", pair.alias("hit")).where("target is not null")
    first = names.groupBy("target").agg(F.min_by("hit", "id").alias("hit"))
    met = hits.select("target").distinct().join(first, "target", "left")
    both = F.array_distinct(F.when(F.col("hit.i").isNull(), F.array("target")).otherwise(F.array("hit.i", "hit.p")))
    return met.select(F.explode(both).alias("target")).crossJoin(F.broadcast(query.select("repo_id", "query_tokens"))).select("repo_id", "query_tokens", "target", F.lit(as_of).cast("timestamp").alias("created_at"))


def recall(notes: DataFrame, files: DataFrame, repo_id: str, query: str | None = None, tag: str | None = None, most: int = 10, index: Index | None = None) -> DataFrame:
    """Notes of a repository that a query finds, or the most useful and latest ones, with place, changed_files and possibly_stale.

    Scores are BM25 over note and tokens of all notes, from ``index``, an index of these fields by id, where there is one, and
    USEFUL_BOOST for each vote.
    """
    rows = notes.where(F.col("repo_id") == repo_id)
    if tag:
        rows = rows.where(F.array_contains("tags", tag.strip().lower()))
    if query and query.strip():
        scores = search.bm25(notes, query, "id", dict.fromkeys(FIELDS, 1.0)) if index is None else index.bm25(query)
        rows = rows.join(scores, "id").withColumn("score", F.round(F.col("score") + USEFUL_BOOST * F.col("useful_count"), 6))
    else:
        rows = rows.withColumn("score", F.lit(None).cast("double"))
    order = [F.desc("score"), F.desc("id")] if query and query.strip() else [F.desc("useful_count"), F.desc("updated_at"), F.desc("id")]
    top = search.ranked(rows, order, most).withColumnRenamed("rank", "place")
    stale = indexing.staleness(top, files.where(F.col("repo_id") == repo_id))
    return top.join(stale.select("id", F.col("stale_files").alias("changed_files"), F.col("stale").alias("possibly_stale")), "id", "left")
