"""Index a folder from a shell or a hook: python -m strata.cli index|rebuild|status|verify|stats FOLDER [--store FOLDER] [--changed]."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import indexing, learnings
from .operators.store import Store
from .sources import files


def run(spark: SparkSession, command: str, folder: str, store: Store, changed_only: bool = False, now: dt.datetime | None = None) -> DataFrame:
    """What a command answers, in one row. A store has one writer, so a command that finds another at work says so and does nothing."""
    now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    root = os.path.realpath(folder)
    repo = spark.range(1).select(indexing.repo_id(F.lit(root))).first()[0]
    git = os.path.isdir(os.path.join(root, ".git"))
    if command == "stats":
        return learnings.stats(store.read("learnings"), store.read("proposals"))
    snapshot = files.scan_repository(spark, root)
    mine = store.read("files").where(F.col("repo_id") == repo)
    if command == "status":
        return indexing.freshness(mine, snapshot, files.git_changes(spark, root) if git else None)
    if command == "verify":
        return indexing.verify_index(mine, snapshot, store.read("contents"))
    only = [r["path"] for r in files.git_changes(spark, root).collect()] if changed_only and git else None
    with store.lease(repo) as held:
        if not held:
            return spark.createDataFrame([(repo, "another run is at work")], "repo_id string, skipped string")
        return indexing.index_run(store, repo, root, snapshot, now, force=command == "rebuild", only_paths=only, head_sha=files.git_head(root) if git else None)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=("index", "rebuild", "status", "verify", "stats"))
    parser.add_argument("folder")
    parser.add_argument("--store")
    parser.add_argument("--changed", action="store_true", help="only paths that differ from the last commit")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    for row in run(spark, given.command, given.folder, Store.at(spark, given.store), given.changed).collect():
        print(json.dumps(row.asDict(recursive=True), default=str))


if __name__ == "__main__":
    main()
