"""A stream of file changes that keeps a store's index."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import indexing
from ..operators.store import Store
from ..sources import tables


def apply_changes(batch: DataFrame, store: Store, repo: str, root: str, as_of: dt.datetime, stream: str = "", number: int | None = None, **settings) -> DataFrame | None:
    """Index the changed files of a batch: rows (path, at, deleted, size, modified, language, content_hash, text); returns the run's counters.

    Of a path's rows the last one by ``at`` counts, and only if it is later than what the store knows of that path, so late
    and repeated rows change nothing, whatever came before. ``number`` of ``stream`` is kept beside the generation.
    """
    last = batch.groupBy(F.col("path").alias("_path")).agg(F.max_by(F.struct(*batch.columns), "at").alias("r")).select("r.*")
    known = store.read("changes").where(F.col("repo_id") == repo).select("path", F.col("at").alias("_known"))
    fresh = tables.staged(last.join(known, "path", "left").where(F.col("_known").isNull() | (F.col("at") > F.col("_known"))).drop("_known"), "fresh")
    if fresh.isEmpty():
        tables.drop(fresh)
        return None
    mark = None if number is None else (stream, number)
    out = indexing.index_run(store, repo, root, fresh.where(~F.coalesce("deleted", F.lit(False))), as_of, only_paths=fresh, batch=mark, **settings)
    store.put("changes", fresh.select(F.lit(repo).alias("repo_id"), "path", "at"), None, store.next_seq())
    tables.drop(fresh)
    return out


def maintain(changes: DataFrame, store: Store, repo: str, root: str, checkpoint: str, as_of: dt.datetime, lease_seconds: float = 120.0, **settings) -> None:
    """Index a stream of changes until what it has now is done; each batch under the repository's lease, which one writer has.

    A batch that finds another writer fails, and is given again when the stream is started again.
    """

    def one(batch: DataFrame, number: int) -> None:
        with store.lease(repo, lease_seconds) as held:
            if not held:
                raise RuntimeError(f"Another writer indexes {repo}.")
            apply_changes(batch, store, repo, root, as_of, checkpoint, number, **settings)

    changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def refresh(store: Store, repo: str, root: str, snapshot: DataFrame, as_of: dt.datetime, off: bool = False, **settings) -> tuple[str, DataFrame | None]:
    """(what was done about a stale index before a search, the run's counters if there was one): "fresh", "inline", or "background" and "off",
    where the caller runs index_run later or not at all; "busy" while another writer is at work."""
    mine = store.read("files").where(F.col("repo_id") == repo)
    state = indexing.freshness(mine, snapshot).first()
    if state["stale"] is False:
        return "fresh", None
    policy = indexing.refresh_policy(not mine.isEmpty(), state["changed"], off=off)
    if policy != "inline":
        return policy, None
    with store.lease(repo) as held:
        return ("inline", indexing.index_run(store, repo, root, snapshot, as_of, **settings)) if held else ("busy", None)
