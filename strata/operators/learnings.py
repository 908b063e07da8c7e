"""Observation records: recording with dedup by fingerprint, feedback, filters, confidence, conflicts, recommendations,
summaries, logs in Markdown, proposals and their dispatch.

Each function takes tables and returns what a table becomes, so a caller may write it to a store or go on with it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources import tables
from . import search
from .inverted import Index
from .notes import file_stem

HALF_LIFE_DAYS, FLOOR = 90.0, 0.3
CORROBORATIONS, DISPATCHES_A_DAY = 3, 2
OUTCOMES = ("worked", "failed", "partial")
STATUSES = ("draft", "dispatched", "pr_opened", "merged", "rejected", "failed")
#: Records that a period's summary looks at, and that an export writes, at most.
SUMMARY_MOST, EXPORT_MOST = 500, 1000


def fingerprint(outcome: Column, title: Column, repo: Column, files: Column, tool: Column) -> Column:
    """A record's identity: case and punctuation of the title do not count, the outcome does."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.md5(F.concat_ws("\n", F.lower(outcome), T.normalize_title(title), blank(repo), F.array_join(F.array_sort(T.normalize_files(files)), ","), F.lower(blank(tool))))


def merge_records(records: DataFrame, fp: str = "fingerprint", seq: str = "seq", at: str = "seen_at") -> DataFrame:
    """One row for each fingerprint of records (fp, seq, title, detail, tags, provider, at).

    occurrences counts; the first title stays; the longest detail wins and the earlier of equal ones; tags are
    united in first-seen order; provider is the last one given; last_seen is the latest.
    """
    order = F.col(seq)
    tags = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("s"), F.coalesce("tags", F.array().cast("array<string>")).alias("t")))), lambda x: x["t"])))
    detail = F.coalesce(F.col("detail"), F.lit(""))
    return records.groupBy(fp).agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.min_by("title", order).alias("title"),
        F.max_by(detail, F.struct(F.length(detail), -order)).alias("detail"),
        tags.alias("tags"),
        F.max_by("provider", F.when(F.col("provider").isNotNull(), order)).alias("provider"),
        F.max(at).alias("last_seen"),
    )


def normalized(inputs: DataFrame) -> DataFrame:
    """Inputs (seq, outcome, title, detail, category, tags, repo, files, tool, provider, model, evidence, source, seen_at)
    as they are stored: redacted, normalised, with fingerprint and tokens."""
    return _stated(inputs).withColumn("tokens", T.split_identifiers(F.col("words"))).drop("words")


def _stated(inputs: DataFrame) -> DataFrame:
    """As normalized(), with ``words``, the text that tokens are made of, in their place."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    rows = inputs.select(
        "seq",
        F.lower("outcome").alias("outcome"),
        T.redact_rare(F.trim("title")).alias("title"),
        F.coalesce(T.redact_rare(F.trim("detail")), F.lit("")).alias("detail"),
        F.coalesce(F.lower(blank("category")), F.lit("general")).alias("category"),
        T.normalize_tags(F.col("tags")).alias("tags"),
        T.normalize_repo(F.col("repo")).alias("repo"),
        T.normalize_files(F.col("files")).alias("files"),
        blank("tool").alias("tool"),
        F.lower(blank("provider")).alias("provider"),
        blank("model").alias("model"),
        T.redact_rare(F.trim("evidence")).alias("evidence"),
        F.col("source"),
        "seen_at",
    )
    words = F.concat_ws(" ", "title", "detail", F.coalesce("tool", F.lit("")), "category", F.array_join("tags", " "), F.array_join(F.transform("files", file_stem), " "))
    return rows.withColumn("fingerprint", fingerprint(F.col("outcome"), F.col("title"), F.col("repo"), F.col("files"), F.col("tool"))).withColumn("words", words)


def record(learnings: DataFrame, inputs: DataFrame) -> DataFrame:
    """``learnings`` with inputs recorded in order of ``seq``, and ``created``: whether a row is new.

    A repeat of a fingerprint counts once more, keeps the longer detail and evidence and the earlier title, adds its
    tags after the known ones, takes the newest tokens and the last provider and model that are given.
    """
    return record_folded(learnings, folded(inputs))


def folded(inputs: DataFrame) -> DataFrame:
    """What each fingerprint of inputs adds to a table of records, whatever that holds: a row each, for record_folded()."""
    new = _stated(inputs)
    order = F.col("seq")
    given = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    longest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.length(c), -order)))
    tags = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "tags"))), lambda x: x["tags"])))
    first = {c: F.min_by(c, order) for c in ("outcome", "category", "title", "repo", "files", "tool", "source")}
    rows = new.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"), longest("detail").alias("detail"), longest("evidence").alias("evidence"), tags.alias("tags"), F.max_by("words", order).alias("words"), given("provider").alias("provider"),
        given("model").alias("model"), F.max("seen_at").alias("seen"), F.min("seen_at").alias("began"), F.min(order).alias("first_seq"), *[v.alias(k) for k, v in first.items()],
    )
    return rows.withColumn("tokens", T.split_identifiers(F.col("words"))).drop("words")  # of the newest only


def record_folded(learnings: DataFrame, folded: DataFrame) -> DataFrame:
    """As record(), of inputs that folded() has put together."""
    n = folded.select(*[F.col(c).alias("fingerprint" if c == "fingerprint" else f"n_{c}") for c in folded.columns])
    old = learnings.withColumn("_known", F.lit(True))
    met = tables.staged(old.join(n, "fingerprint", "full"), "recorded")  # what follows, and each table made of it, reads it several times
    known, told = F.coalesce("_known", F.lit(False)), F.col("n_n").isNotNull()
    last = learnings.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
    fresh = tables.numbered(met.where(~known), ["n_first_seq"], "_place").crossJoin(F.broadcast(last))  # one row
    longer = lambda c: F.when(F.coalesce(F.length(f"n_{c}"), F.lit(0)) > F.coalesce(F.length(c), F.lit(0)), F.col(f"n_{c}")).otherwise(F.col(c))
    merged = {
        "occurrences": F.col("occurrences") + F.coalesce("n_n", F.lit(0)), "detail": longer("detail"), "evidence": longer("evidence"),
        "tags": F.when(told, F.array_union("tags", "n_tags")).otherwise(F.col("tags")), "tokens": F.coalesce("n_tokens", "tokens"), "provider": F.coalesce("n_provider", "provider"),
        "model": F.coalesce("n_model", "model"), "last_seen": F.greatest("last_seen", "n_seen"),
    }
    made = {"id": F.col("_last") + F.col("_place"), "fingerprint": F.col("fingerprint"), "occurrences": F.col("n_n"), "useful": F.lit(0), "created_at": F.col("n_began"), "last_seen": F.col("n_seen")}
    types = {f.name: f.dataType for f in learnings.schema.fields}
    was = met.where(known).select(*[merged.get(c, F.col(c)).cast(types[c]).alias(c) for c in learnings.columns], F.lit(False).alias("created"))
    is_new = fresh.select(*[made.get(c, F.col(f"n_{c}") if f"n_{c}" in fresh.columns else F.lit(None)).cast(types[c]).alias(c) for c in learnings.columns], F.lit(True).alias("created"))
    return was.unionByName(is_new)


def mark_learning_useful(learnings: DataFrame, ids: list[int]) -> DataFrame:
    """``learnings`` with one vote more for each distinct id."""
    return learnings.withColumn("useful", F.col("useful") + F.col("id").isin(sorted(set(ids))).cast("long"))


def forget_learning(learnings: DataFrame, learning_id: int) -> DataFrame:
    """``learnings`` without one; proposals keep their own copy of its text."""
    return learnings.where(F.col("id") != learning_id)


def feedback_rows(inputs: DataFrame) -> DataFrame:
    """Rows of tool_feedback for inputs (id, tool, worked, note, repo, provider, created_at): trimmed, redacted, normalised."""
    return inputs.select("id", F.trim("tool").alias("tool"), "worked", T.redact(F.col("note")).alias("note"), T.normalize_repo(F.col("repo")).alias("repo"), F.lower(F.trim("provider")).alias("provider"), "created_at")


def filtered(learnings: DataFrame, repo: str | None = None, outcome: str | None = None, category: str | None = None, tag: str | None = None, tool: str | None = None, since: dt.datetime | None = None) -> DataFrame:
    """The records that fit all that is asked for; a repository's are also those of none."""
    if outcome is not None and outcome.lower() not in OUTCOMES:
        raise ValueError(f"One of {', '.join(OUTCOMES)}: {outcome!r}")
    rows = learnings.where(in_repo(F.col("repo"), repo.strip().lower() if repo else None))
    for column, wanted in (("outcome", outcome), ("category", category)):
        if wanted:
            rows = rows.where(F.col(column) == wanted.strip().lower())
    if tag:
        rows = rows.where(F.array_contains("tags", tag.strip().lower()))
    if tool:
        rows = rows.where(F.lower("tool") == tool.strip().lower())
    return rows.where(F.col("last_seen") >= F.lit(since)) if since else rows


#: The fields that are searched, each with weight 1.
FIELDS = ("title", "detail", "tokens")


def query_learnings(learnings: DataFrame, query: str | None = None, most: int = 20, index: Index | None = None, **filters) -> DataFrame:
    """Up to ``most`` records that filters let through, with place: those that a query finds, best first, or the latest.

    BM25 is over FIELDS of all records, whatever the filters; from ``index``, an index of these fields by id, where there is one.
    """
    rows = filtered(learnings, **filters)
    if query and query.strip():
        scores = search.bm25(learnings, query, "id", dict.fromkeys(FIELDS, 1.0)) if index is None else index.bm25(query)
        rows = rows.join(scores.withColumn("score", F.round("score", 6)), "id")
        order = [F.desc("score"), F.col("id")]
    else:
        rows, order = rows.withColumn("score", F.lit(None).cast("double")), [F.desc("last_seen"), F.col("id")]
    return search.ranked(rows, order, max(1, min(most, 200))).withColumnRenamed("rank", "place")


def candidates(learnings: DataFrame, task: str | None, repo: str | None, tags: tuple[str, ...] = (), most: int = 8, index: Index | None = None) -> DataFrame:
    """What get_recommendations looks at: four times ``most`` found by the task and tags, then, if these are fewer than
    ``most``, the latest ones that are not among them, of twice ``most``; ``place`` goes on."""
    text = " ".join([task or "", *tags]).strip()
    if not text:
        return query_learnings(learnings, None, most * 4, repo=repo)
    found = query_learnings(learnings, text, most * 4, index, repo=repo)
    n = found.agg(F.count(F.lit(1)).alias("_n"))  # one row
    extra = query_learnings(learnings, None, most * 2, repo=repo).join(found.select("id"), "id", "left_anti").crossJoin(F.broadcast(n)).where(F.col("_n") < most)
    return found.unionByName(extra.withColumn("place", F.col("_n").cast("int") + F.col("place")).drop("_n").select(*found.columns))


def in_repo(repo: Column, wanted: str | None) -> Column:
    """Rows of a repository and rows of none, which are for all."""
    return F.lit(True) if wanted is None else (repo == wanted) | repo.isNull()


def confidence(occurrences: Column, useful: Column, last_seen: Column, as_of: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Corroboration times an age factor that never falls below FLOOR; in doubles, not rounded."""
    days = F.greatest((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last_seen.cast("timestamp"))) / 86400e6, F.lit(0.0))
    return (1 - 1 / (1 + occurrences + useful)) * (FLOOR + (1 - FLOOR) * F.pow(F.lit(0.5), days / half_life))


def conflicts(records: DataFrame) -> DataFrame:
    """``records`` with ``conflict``: whether of one title, tool and repository some worked and some failed."""
    key = F.concat_ws("|", T.normalize_title(F.col("title")), F.lower(F.coalesce("tool", F.lit(""))), F.coalesce("repo", F.lit("")))
    rows = records.withColumn("_key", F.md5(key))
    any_ = lambda o: F.max((F.col("outcome") == o).cast("int")) == 1
    both = rows.groupBy("_key").agg((any_("worked") & any_("failed")).alias("conflict"))
    return rows.join(both, "_key").drop("_key")


def recommend(records: DataFrame, as_of: str, repo: str | None = None, most: int = 5) -> DataFrame:
    """The best records of each kind of advice: (id, advice, conflict, confidence, place).

    Conflicting records come first, then confidence, then id. Global records count for 0.8 where a repository is asked for.
    """
    scale = F.lit(1.0) if repo is None else F.when(F.col("repo").isNull(), 0.8).otherwise(1.0)
    score = confidence(F.col("occurrences"), F.col("useful"), F.col("last_seen"), F.lit(as_of)) * scale
    rows = conflicts(records.where(in_repo(F.col("repo"), repo)))
    advice = F.when(F.col("outcome") == "worked", "do").when(F.col("outcome") == "failed", "avoid").otherwise("caution")
    rows = rows.select("id", advice.alias("advice"), "conflict", F.bround(score, 3).alias("confidence"))
    place = F.row_number().over(Window.partitionBy("advice").orderBy(F.desc("conflict"), F.desc("confidence"), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def get_recommendations(learnings: DataFrame, as_of: str, task: str | None = None, repo: str | None = None, tags: tuple[str, ...] = (), most: int = 8, index: Index | None = None) -> DataFrame:
    """What to do, to avoid and to beware of for a task: (id, advice, title, detail, tool, tags, files, occurrences, useful, confidence,
    last_seen, conflict, evidence, place), at most ``most`` of each advice.

    Candidates are found first, so their number bounds all that follows. Where some of one title, tool and repository worked
    and some failed, these come first; then confidence counts, then the order in which the search found the first of each
    such group, then the latest of it. Records of no repository count for 0.8 where one is asked for.
    """
    repo = repo and repo.strip().lower() or None
    tags = tuple(dict.fromkeys(t.strip().lower() for t in tags if t.strip()))
    found = tables.staged(candidates(learnings, task, repo, tags, most, index), "candidates")
    key = F.concat_ws("|", T.normalize_title(F.col("title")), F.lower(F.coalesce("tool", F.lit(""))), F.coalesce("repo", F.lit("")))
    group = Window.partitionBy("_key")
    any_ = lambda o: F.max((F.col("outcome") == o).cast("int")).over(group) == 1
    rows = found.withColumn("_key", key).withColumn("conflict", any_("worked") & any_("failed")).withColumn("_first", F.min("place").over(group))
    scale = F.lit(1.0) if repo is None else F.when(F.col("repo").isNull(), 0.8).otherwise(1.0)
    rows = rows.withColumn("confidence", F.bround(confidence(F.col("occurrences"), F.col("useful"), F.col("last_seen"), F.lit(as_of)) * scale, 3))
    advice = F.when(F.col("outcome") == "worked", "do").when(F.col("outcome") == "failed", "avoid").otherwise("caution")
    order = Window.partitionBy("advice").orderBy(F.desc("conflict"), F.desc("confidence"), "_first", F.desc("last_seen"), "place")
    rows = rows.withColumn("advice", advice).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    shown = {"detail": T.truncate(F.col("detail"), 600), "evidence": F.nullif(T.truncate(F.col("evidence"), 300), F.lit(""))}
    columns = ("id", "advice", "title", "detail", "tool", "tags", "files", "occurrences", "useful", "confidence", "last_seen", "conflict", "evidence", "place")
    return rows.select(*[shown[c].alias(c) if c in shown else F.col(c) for c in columns])


def feedback_summary(feedback: DataFrame, tool: str = "tool", worked: str = "worked", at: str = "at") -> DataFrame:
    """(tool, n_worked, n_failed, last_at)."""
    return feedback.groupBy(tool).agg(F.count_if(F.col(worked)).alias("n_worked"), F.count_if(~F.col(worked)).alias("n_failed"), F.max(at).alias("last_at"))


def summarize(records: DataFrame, since: Column, feedback: DataFrame | None = None, proposals: DataFrame | None = None) -> DataFrame:
    """(section, name, n): a period's records by outcome and by category, the ten most corroborated, and how many are ready
    for a proposal; with feedback (tool, worked, at) what failed by tool, with proposals (status, created_at) those by status."""
    rows = records.where(F.col("last_seen") >= since)
    by = lambda name, col, df=rows: df.groupBy(F.col(col).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), "name", "n")
    strength = F.col("occurrences") + F.col("useful")
    top = rows.orderBy(F.desc(strength), "id").limit(10).select(F.lit("corroborated").alias("section"), F.col("id").cast("string").alias("name"), strength.cast("long").alias("n"))
    ready = rows.where(F.col("occurrences") >= CORROBORATIONS).agg(F.count(F.lit(1)).alias("n")).select(F.lit("ready").alias("section"), F.lit("all").alias("name"), "n")
    out = by("outcome", "outcome").unionByName(by("category", "category")).unionByName(top).unionByName(ready)
    if feedback is not None:
        failed = feedback.where((F.col("at") >= since) & ~F.col("worked")).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(failed.select(F.lit("failed tool").alias("section"), F.col("tool").alias("name"), "n"))
    if proposals is not None:
        out = out.unionByName(by("proposal", "status", proposals.where(F.col("created_at") >= since)))
    return out


def stats(records: DataFrame, proposals: DataFrame) -> DataFrame:
    """(total, worked, failed, partial, and the number of proposals of each status) in one row."""
    n = lambda column, value: F.count_if(F.col(column) == value).alias(value if column == "outcome" else f"proposals_{value}")
    a = records.agg(F.count(F.lit(1)).alias("total"), *[n("outcome", o) for o in OUTCOMES])
    return a.crossJoin(F.broadcast(proposals.agg(*[n("status", s) for s in STATUSES])))  # a row each


def proposal(records: DataFrame, by: str, most_files: int = 12) -> DataFrame:
    """For each group: corroborations, strongest title, modal category (ties by name), outcome counts, frequent files."""
    strongest = F.max_by("title", F.struct(F.col("occurrences") + F.col("useful"), F.col("last_seen"), -F.col("id")))
    core = records.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("occurrences").alias("corroborations"), strongest.alias("title"), F.count_if(F.col("outcome") == "worked").alias("n_worked"), F.count_if(F.col("outcome") == "failed").alias("n_failed"))
    counts = records.groupBy(by, "category").agg(F.count(F.lit(1)).alias("c"))
    modal = counts.groupBy(by).agg(F.min_by("category", F.struct(-F.col("c"), F.col("category"))).alias("category"))
    files = records.select(by, F.explode("files").alias("file")).groupBy(by, "file").agg(F.count(F.lit(1)).alias("c"))
    top = files.withColumn("p", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("c"), "file"))).where(F.col("p") <= most_files)
    listed = top.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "file"))), lambda x: x["file"]).alias("likely_files"))
    return core.join(modal, by).join(listed, by, "left")


def dispatchable(proposals: DataFrame, dispatches: DataFrame, as_of: str, least: int = CORROBORATIONS, a_day: int = DISPATCHES_A_DAY) -> DataFrame:
    """Proposals that may be sent: draft or failed, corroborated, while the last day has room."""
    recent = dispatches.where((F.col("created_at") > F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")) & (F.col("created_at") <= F.lit(as_of).cast("timestamp_ntz")) & (F.col("status") != "failed") & (F.col("mode") != "dry-run"))
    room = recent.agg((F.count(F.lit(1)) < a_day).alias("room"))
    return proposals.where(F.col("status").isin("draft", "failed") & (F.col("corroborations") >= least)).crossJoin(F.broadcast(room)).where("room").drop("room")


def create_proposal(records: DataFrame, by: str, as_of: str, default_repo: str, title: Column | None = None, criteria: tuple[str, ...] | None = None, first_id: int = 1) -> DataFrame:
    """Draft proposals, one for each ``by`` of records (id, outcome, category, title, detail, repo, files, tool, occurrences, useful, last_seen).

    The target is the group's most frequent repository, or the default; the title is made from the strongest record
    unless one is given; the rationale lists the ten most frequent ones; the prompt puts all together. Ties go by name or id.
    """
    core = proposal(records, by)
    repos = records.where("repo is not null").groupBy(by, "repo").agg(F.count(F.lit(1)).alias("c")).groupBy(by).agg(F.min_by("repo", F.struct(-F.col("c"), F.col("repo"))).alias("target_repo"))
    failed = F.max_by("outcome", F.struct(F.col("occurrences") + F.col("useful"), F.col("last_seen"), -F.col("id"))) == "failed"
    one = F.struct((-F.col("occurrences")).alias("k"), "id", F.concat(F.lit("- "), F.col("outcome"), F.lit(" ×"), F.col("occurrences").cast("string"), F.lit(": "), F.col("title"), F.coalesce(F.concat(F.lit(" ["), F.nullif("tool", F.lit("")), F.lit("]")), F.lit(""))).alias("line"))
    lines = records.withColumn("_line", one).withColumn("_p", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("occurrences"), "id")))
    told = lines.groupBy(by).agg(F.array_sort(F.collect_list("id")).alias("learning_ids"), failed.alias("_failed"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_p") <= 10, F.col("_line")))), lambda x: x["line"]).alias("_lines"))
    rows = core.withColumnRenamed("title", "_strongest").join(told, by).join(repos, by, "left").withColumn("target_repo", F.coalesce("target_repo", F.lit(default_repo)))
    made = T.truncate(F.concat(F.when(F.col("_failed"), "Prevent").otherwise("Adopt"), F.lit(" ("), F.col("category"), F.lit("): "), F.col("_strongest")), 90)
    counted = F.format_string("%d record(s) seen %d times (%d worked, %d failed, %d partial).", "n", "corroborations", "n_worked", "n_failed", F.col("n") - F.col("n_worked") - F.col("n_failed"))
    rows = rows.withColumn("title", T.redact(title if title is not None else made)).withColumn("rationale", F.array_join(F.concat(F.array(counted), F.col("_lines")), "\n"))
    rows = rows.withColumn("likely_files", F.coalesce("likely_files", F.array().cast("array<string>"))).withColumn("acceptance_criteria", F.array(*[T.redact(F.lit(c.strip())) for c in criteria or ACCEPTANCE]))
    rows = rows.withColumn("prompt", improvement_prompt()).withColumn("status", F.lit("draft")).withColumn("created_at", F.lit(as_of).cast("timestamp")).withColumn("updated_at", F.lit(as_of).cast("timestamp"))
    return tables.numbered(rows, [by], "id", first_id).select("id", by, "status", "target_repo", "title", "rationale", "learning_ids", "likely_files", "acceptance_criteria", "prompt", "corroborations", "created_at", "updated_at")


ACCEPTANCE = ("The change addresses the records listed above.", "Checks and tests that passed before still pass.", "A person reviews the change before it is merged.")


def improvement_prompt() -> Column:
    """The task text of a proposal (target_repo, title, rationale, likely_files, acceptance_criteria)."""
    bullets = lambda c, none: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(none))
    return T.redact(F.concat_ws("\n\n",
        F.concat(F.lit("Improve "), F.col("target_repo"), F.lit(" by what earlier tasks have shown.")),
        F.concat(F.lit("## Goal\n"), F.col("title")),
        F.concat(F.lit("## Why\n"), F.col("rationale")),
        F.concat(F.lit("## Files to look at first\n"), bullets("likely_files", "- not known")),
        F.lit("## Limits\n- Change as little as the goal needs, and nothing that it does not need.\n- Write no credentials.\n- Open a draft and name the records in it."),
        F.concat(F.lit("## Done when\n"), bullets("acceptance_criteria", "- reviewed")),
    ))


def proposal_markdown() -> Column:
    """A proposal as a page: its facts, then its prompt."""
    facts = [("Status", F.col("status")), ("Target", F.col("target_repo")), ("Corroborations", F.col("corroborations").cast("string")), ("Records", F.array_join(F.transform("learning_ids", lambda i: F.concat(F.lit("#"), i.cast("string"))), ", "))]
    return F.concat_ws("\n\n", F.concat(F.lit("# Proposal "), F.col("id").cast("string"), F.lit(": "), F.col("title")), F.concat_ws("\n", *[F.concat(F.lit(f"- {n}: "), v) for n, v in facts]), F.col("prompt"))


def list_proposals(proposals: DataFrame, status: str | None = None, most: int = 50) -> DataFrame:
    """The latest proposals, of one status if that is given."""
    if status is not None and status not in STATUSES:
        raise ValueError(f"One of {', '.join(STATUSES)}: {status!r}")
    rows = proposals if status is None else proposals.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(most, 500)))


def update_proposals(proposals: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """``proposals`` with changes (id, status, and maybe dispatch_mode, external_id, pr_url, last_error) put in by id.

    What a change leaves null stays, but for the error, which is replaced; errors are redacted.
    """
    c = changes.select(F.col("id"), *[(T.redact(F.col(x)) if x == "last_error" else F.col(x)).alias(f"_{x}") if x in changes.columns else F.lit(None).cast("string").alias(f"_{x}") for x in ("status", "dispatch_mode", "external_id", "pr_url", "last_error")], F.lit(True).alias("_hit"))
    met = proposals.join(c, "id", "left")
    put = {x: F.coalesce(f"_{x}", x) for x in ("status", "dispatch_mode", "external_id", "pr_url") if x in proposals.columns}
    put |= {"last_error": F.when(F.col("_hit"), F.col("_last_error")).otherwise(F.col("last_error")) if "last_error" in proposals.columns else None, "updated_at": F.when(F.col("_hit"), F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))}
    return met.select(*[put.get(x, F.col(x)).alias(x) for x in proposals.columns])


def dispatch_rows(inputs: DataFrame) -> DataFrame:
    """Rows of dispatches for inputs (id, proposal_id, mode, request_id, external_id, status, detail, created_at and maybe seq): details cut at 4000 and redacted."""
    kept = ("id", "proposal_id", "mode", "request_id", "external_id", "status", "detail", "created_at", *[c for c in inputs.columns if c == "seq"])
    return inputs.select(*[T.redact(T.truncate(F.col("detail"), 4000)).alias("detail") if c == "detail" else F.col(c) for c in kept])


def dispatch_status(proposals: DataFrame, dispatches: DataFrame) -> DataFrame:
    """(id, status, n_dispatches, last_mode, last_status) of each proposal.

    The last is that of the latest time, then of the largest id, of which null is above all, as in SQL. Where ids repeat, ``dispatches`` should have ``seq``, a
    number: of equal times and ids, the row of the smallest counts.
    """
    first = [-F.col("seq")] if "seq" in dispatches.columns else []
    order = [x for c in ("created_at", "id") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    last = dispatches.groupBy(F.col("proposal_id").alias("id")).agg(F.count(F.lit(1)).alias("n_dispatches"), F.max_by(F.struct("mode", "status"), F.struct(*order, *first)).alias("l"))
    return proposals.select("id", "status").join(last, "id", "left").select("id", "status", F.coalesce("n_dispatches", F.lit(0)).alias("n_dispatches"), F.col("l.mode").alias("last_mode"), F.col("l.status").alias("last_status"))


# Fixed values of the log's format: a dated heading, the kinds of task entries with their other names, and field names.
_HEADING = r"(?m)^##\s+(\d{4}-\d{2}-\d{2})\s+[—-]+\s+(\S+)[ \t]*$"
_TASKS = {"squad": "squad", "build": "squad", "squad-review": "squad-review", "review": "squad-review"}


_FIELDS = ("Entrypoint", "Result", "Next tweak", "Provider", "Model tier", "Outcome", "Title", "Detail", "Category", "Tags", "Repo", "Files", "Tool", "Handoff themes", "Evidence")
_FIELD = rf"(?mi)^-\s+(?:{'|'.join(_FIELDS)}):.*$"


def parse_log(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, entry, date, kind, outcome, title, detail, category, tags, repo, files, tool, provider, evidence) of a Markdown log.

    Entries begin with a dated heading. Those of a task have its result and next step, those named "learning" all
    fields of a record; other headings are left out.
    """
    block = F.col("block")
    entries = F.filter(F.split(F.regexp_replace(text, "\r\n", "\n"), r"(?m)(?=^##\s+\d{4}-\d{2}-\d{2}\s)"), lambda b: F.regexp_like(b, F.lit(_HEADING)))
    field = lambda name: F.col(f"_{name}")
    given = lambda name: F.when(F.lower(field(name)) != "none", field(name))
    names = F.create_map(*[F.lit(x) for kv in _TASKS.items() for x in kv])
    rows = texts.select(key, F.posexplode(F.filter(F.transform(entries, lambda b: F.struct(b.alias("block"), F.lower(F.trim(F.regexp_extract(b, _HEADING, 2), F.lit("/"))).alias("kind"))), lambda e: e["kind"].isin("learning", *_TASKS))).alias("entry", "e")).select(key, "entry", F.col("e.block").alias("block"), F.col("e.kind").alias("heading"))
    # all fields are found at once; of fields of one name the first counts
    rows = rows.withColumn("_lines", F.regexp_extract_all(block, F.lit(_FIELD), 0))
    rows = rows.withColumn("_names", F.transform("_lines", lambda x: F.ltrim(F.lower(F.substring_index(x, ":", 1)), F.lit("- \t\n\x0b\f\r"))))
    value = lambda x: F.trim(F.ltrim(F.substr(x, F.locate(":", x) + 1), F.lit(" \t")))
    rows = rows.withColumns({f"_{n}": F.nullif(value(F.get("_lines", F.array_position("_names", F.lit(n.lower())) - 1)), F.lit("")) for n in _FIELDS})
    task = F.col("heading") != "learning"
    entry = F.lower(F.trim(F.coalesce(field("Entrypoint"), F.col("heading")), F.lit("/ ")))
    entry = F.coalesce(F.element_at(names, entry), entry)
    result = F.coalesce(F.lower(field("Result")), F.lit(""))
    date = F.regexp_extract(block, _HEADING, 1)
    tweak = given("Next tweak")
    provider = F.lower(field("Provider"))
    task_title = F.concat(F.lit("/"), entry, F.lit(" "), result, F.coalesce(F.concat(F.lit(": "), tweak), F.concat(F.lit(" ("), date, F.lit(")"))))
    task_tags = F.filter(F.array(F.lit("squad"), entry, result, provider, F.concat(F.lit("tier:"), F.lower(F.coalesce(field("Model tier"), F.lit("inherit"))))), lambda t: t.isNotNull())
    stated = F.lower(field("Outcome"))
    either = lambda a, b: F.when(task, a).otherwise(b)
    none = F.array().cast("array<string>")
    return rows.select(
        key, "entry", date.alias("date"), either(entry, F.lit("learning")).alias("kind"),
        either(F.when(result == "pass", "worked").when(result.isin("fail", "failed", "stopped"), "failed").otherwise("partial"), F.when(stated.isin(*OUTCOMES), stated).otherwise("partial")).alias("outcome"),
        either(task_title, F.coalesce(field("Title"), F.lit("Untitled learning"))).alias("title"), either(F.rtrim(block), field("Detail")).alias("detail"), either(F.lit("squad"), field("Category")).alias("category"),
        either(task_tags, T.split_list(field("Tags"))).alias("tags"), either(F.lit(None).cast("string"), field("Repo")).alias("repo"), either(none, T.split_list(field("Files"))).alias("files"),
        either(entry, given("Tool")).alias("tool"), either(F.nullif(provider, F.lit("")), given("Provider")).alias("provider"), either(given("Handoff themes"), field("Evidence")).alias("evidence"),
    )


def log_records(texts: DataFrame, key: str, as_of: str, repo: str | None = None) -> DataFrame:
    """All entries of logs, folded and written, for record_folded()."""
    parsed = tables.staged(parse_log(tables.dealt(texts, key), key), "parsed")
    keys = tables.numbered(parsed.select(F.col(key).alias("_key")).distinct(), ["_key"], "_log")
    rows = parsed.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("seq", F.shiftleft("_log", 32) + F.col("entry"))  # logs in order, entries in theirs
    found = tables.staged(folded(rows.select("seq", "outcome", "title", "detail", "category", "tags", F.coalesce("repo", F.lit(repo).cast("string")).alias("repo"), "files", "tool", "provider", F.lit(None).cast("string").alias("model"), "evidence", F.lit("import").alias("source"), F.lit(as_of).cast("timestamp").alias("seen_at"))), "folded")
    tables.drop(parsed)
    return found


def import_log(learnings: DataFrame, texts: DataFrame, key: str, as_of: str, repo: str | None = None) -> DataFrame:
    """``learnings`` with a log's entries recorded in order; an import again only counts them once more. As record()."""
    return record_folded(learnings, log_records(texts, key, as_of, repo))


def format_entry() -> Column:
    """A record as an entry of the log: a task's own text where its detail is one, else all its fields."""
    said = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("None"))
    own = [("Outcome", F.col("outcome")), ("Category", F.col("category")), ("Title", F.col("title")), ("Detail", T.one_line(F.col("detail"))), ("Repo", F.col("repo")), ("Tags", T.listed(F.col("tags"))), ("Files", T.listed(F.col("files"))), ("Tool", said("tool")), ("Provider", said("provider")), ("Occurrences", F.col("occurrences").cast("string")), ("Evidence", F.when(F.coalesce(F.col("evidence"), F.lit("")) != "", T.one_line(F.col("evidence"))))]
    whole = F.concat_ws("\n", F.concat(F.lit("## "), F.date_format("last_seen", "yyyy-MM-dd"), F.lit(" — learning")), F.lit(""), *[F.concat(F.lit(f"- {n}: "), v) for n, v in own])
    return F.when((F.col("category") == "squad") & F.regexp_like("detail", F.lit(_HEADING)), F.rtrim("detail")).otherwise(whole)


def export_log(learnings: DataFrame, existing: str | None = None, most: int = EXPORT_MOST) -> DataFrame:
    """(place, text): the entries of the latest ``most`` records, in order of when they were last seen, that ``existing`` does not hold yet."""
    rows = learnings.orderBy(F.desc("last_seen"), "id").limit(most)
    entries = rows.select("last_seen", "id", F.trim(format_entry()).alias("text"))
    if existing:
        entries = entries.where(~F.contains(F.lit(existing.replace("\r\n", "\n")), F.col("text")))
    once = entries.groupBy("text").agg(F.min(F.struct("last_seen", "id")).alias("at"))
    return once.select(F.row_number().over(Window.orderBy("at")).alias("place"), "text")


def appended(existing: str | None, entries: list[str]) -> str:
    """A log with new entries after what it holds; a new one begins with its title."""
    body = (existing or "").replace("\r\n", "\n")
    body = body if not body or body.endswith("\n") else body + "\n"
    return (body if body.strip() else "# Learnings\n") + "".join(f"\n{e}\n" for e in entries)
