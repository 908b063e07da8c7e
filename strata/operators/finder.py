"""Search of a store from end to end: refresh by policy elsewhere, then indexes, fusion, boosts from feedback, and a memory of what was shown."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from . import indexing, search
from .search import CHUNK_FIELDS, SYMBOL_FIELDS, Filters
from .store import Store


def chunk_hits_of(scores: DataFrame, store: Store, files: DataFrame, query: str, by: Filters, most: int) -> DataFrame:
    """The best chunks as ranked hits. Chunks are ranked by their places alone; the texts of the few that stay are fetched by content."""
    places = indexing.chunk_ids(store.read("chunks").select("content_hash", "ordinal", "start_line", "end_line", "heading"))
    rows = by.apply(files.join(places.join(scores, "chunk_id"), "content_hash"))
    top = search.ranked(rows.withColumn("score", F.round("score", 9)), [F.desc("score"), "path", "start_line"], most)
    top = tables.staged(top, "hits")
    return search.chunk_hits(_texts(store, top), F.coalesce(search.snippet(F.col("text"), query), F.lit("")))


def _texts(store: Store, top: DataFrame) -> DataFrame:
    """A limited, staged top with its chunks' texts: their contents are named in the filter, which reaches the files."""
    wanted = [r[0] for r in top.select("content_hash").distinct().collect()]
    texts = store.read("chunks").where(F.col("content_hash").isin(wanted)).select("content_hash", "ordinal", "text")
    return texts.join(F.broadcast(top), ["content_hash", "ordinal"])


def vector_hits_of(store: Store, files: DataFrame, asked: list[float], model: str, by: Filters, most: int) -> DataFrame:
    """The chunks whose vectors are most like one, as ranked hits."""
    from ..functions import vectors as V

    like = V.cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in asked]))
    near = store.read("embeddings").where(F.col("model") == model).select("content_hash", "ordinal", F.round(like, 9).alias("similarity")).where(F.col("similarity") > search.LEAST_SIMILARITY)
    rows = Filters(by.language).apply(files.join(near, "content_hash"))
    rows = rows.where(F.col("path").startswith(by.path_prefix)) if by.path_prefix else rows
    top = tables.staged(search.ranked(rows, [F.desc("similarity"), "path", "ordinal"], most), "hits")
    places = store.read("chunks").select("content_hash", "ordinal", "start_line", "end_line", "heading")
    shown = F.when(F.length("text") > 400, F.concat(F.left("text", F.lit(400)), F.lit("…"))).otherwise(F.col("text"))
    return search.chunk_hits(_texts(store, top).join(places, ["content_hash", "ordinal"]), shown)


def find(store: Store, repo: str, text: str, as_of: str, by: Filters = Filters(), most: int = 20, vector: list[float] | None = None, model: str = "words", query_id: str | None = None) -> DataFrame:  # noqa: B008  frozen
    """The hits of search_code() for a query over what index_run has put into a store (with ``searchable``).

    Names, full text of symbols and of chunks, and with ``vector`` the chunks' vectors, are fused; feedback on earlier
    queries raises paths and hits. With ``query_id`` the store remembers the hits, so that feedback can name them.
    """
    files = store.read("files").where(F.col("repo_id") == repo).select("path", "content_hash", "language")
    symbols = indexing.symbol_ids(store.read("symbols"))
    of_symbols, of_chunks = indexing.text_indexes(store)
    legs = {"exact": search.exact_leg(symbols, files, text, by, min(most, 10))}
    if of_symbols.segments():
        legs["symbols"] = search.symbol_leg(of_symbols.bm25(text, SYMBOL_FIELDS), symbols, files, by, 2 * most)
    if of_chunks.segments():
        legs["text"] = chunk_hits_of(of_chunks.bm25(text, CHUNK_FIELDS), store, files, text, by, 2 * most)
    if vector is not None:
        legs["vector"] = vector_hits_of(store, files, vector, model, by, 2 * most)
    feedback = store.read("search_feedback").where(F.col("repo_id") == repo).withColumnRenamed("query_tokens", "tokens")
    hits = search.search_code(legs, search.feedback_boosts(feedback, text, as_of), most)
    if query_id is None:
        return hits
    hits = tables.staged(hits, "shown")
    store.append("queries", search.remembered(hits, query_id, repo, text, as_of))
    return hits


def useful(store: Store, query_id: str, places: list[int], as_of: dt.datetime) -> DataFrame:
    """Note that hits of a remembered query, by place from 1, were useful: a row of feedback for each hit and for its path; returns them."""
    asked = store.read("queries").where(F.col("query_id") == query_id)
    hit = F.posexplode("hits").alias("pos", "hit")
    rows = asked.select("repo_id", "query_tokens", hit).where((F.col("pos") + 1).isin(places))
    targets = rows.select("repo_id", "query_tokens", F.explode(F.array_distinct(F.array("hit.id", "hit.path"))).alias("target"))
    first = store.next_id("search_feedback")
    # a few rows, which the caller has named: their numbers need no more than one task
    listed = sorted(targets.distinct().collect())
    made = [(first + i, *r, as_of) for i, r in enumerate(listed)]
    out = store.spark.createDataFrame(made, "id long, repo_id string, query_tokens string, target string, created_at timestamp")
    store.append("search_feedback", out)
    return out
