"""Queries over a store of files, symbols, chunks, notes and records that is made of the test tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import finder, indexing, learnings, notes, search
from ..operators.inverted import Index
from ..operators.store import Store
from ..sources import files, tables
from .registry import AS_OF, ORACLE_SQL, QUERIES, bm25_sql, query, redact_sql, words_sql

NOW = dt.datetime.fromisoformat(AS_OF)

# --- the hybrid search: documents are files, their first words symbols, their line windows chunks -----------------


def _files(spark, sf_dir) -> DataFrame:
    d = tables.load(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("content_hash"), F.col("lang").alias("language"))


def _contents(spark, sf_dir) -> DataFrame:
    return tables.load(spark, sf_dir, "documents").select(F.md5("text").alias("content_hash"), "text").dropDuplicates(["content_hash"])


def _symbols(spark, sf_dir) -> DataFrame:
    rows = _contents(spark, sf_dir).select("content_hash", T.first_words(F.col("text"), 8).alias("w")).where(F.size("w") > 0)
    first = F.element_at("w", 1)
    return rows.select(F.col("content_hash").alias("symbol_id"), "content_hash", first.alias("name"), F.array_join(F.slice("w", 1, 3), ".").alias("full_name"), F.lit("opening").alias("kind"), F.array_join(F.slice("w", 1, 8), " ").alias("signature"), F.lit(None).cast("string").alias("doc"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lower(first).alias("tokens"))


def _chunks(spark, sf_dir) -> DataFrame:
    rows = indexing.window_chunks(_contents(spark, sf_dir), "content_hash").withColumnRenamed("chunk", "text")
    words = T.first_words(F.col("text"), 3)
    heading = F.when((F.col("ordinal") == 0) & (F.size(words) > 0), F.array_join(words, " "))
    return rows.withColumn("heading", heading).withColumn("tokens", F.lower("heading")).withColumn("chunk_id", F.concat_ws(":", "content_hash", F.col("ordinal").cast("string")))


def _index(spark, sf_dir, name: str, rows, key: str, fields: dict[str, float]) -> str:
    """The path of an index over derived rows; made where the documents' present files have none yet."""
    path = f"{tables.work_folder(spark)}/index/blocks-{name}-{tables.version(spark, sf_dir, 'documents')}"
    if not tables.exists(spark, f"{path}/postings/_SUCCESS"):
        search.write_index(rows(spark, sf_dir), path, key, fields)
    return path


def _feedback(spark, sf_dir) -> DataFrame:
    """What users found useful: the document of a user's number, by its path."""
    ev = tables.load(spark, sf_dir, "events")
    d = tables.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("target"))
    return ev.join(d, "user_id").select(F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", F.lit("the")).alias("tokens"), "target", F.col("ts").alias("created_at"))


_STORE = rf"""f AS (SELECT source || '/' || doc_id AS path, md5(text) AS content_hash, lang AS language, doc_id FROM documents),
co AS (SELECT DISTINCT md5(text) AS content_hash, text FROM documents),
sy AS (SELECT content_hash AS symbol_id, content_hash, w[1] AS name, array_to_string(list_slice(w, 1, 3), '.') AS full_name, array_to_string(list_slice(w, 1, 8), ' ') AS signature, NULL::VARCHAR AS doc, lower(w[1]) AS tokens
       FROM (SELECT content_hash, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w FROM co) WHERE len(w) > 0),
cl AS (SELECT content_hash, string_split_regex(text, '\r?\n') AS l FROM co),
cw AS (SELECT content_hash, l, unnest(range(1, greatest(1, ceil((len(l) - 10) / 70.0)::INT * 70 - 70 + 1) + 1, 70)) AS s FROM cl),
cc AS (SELECT content_hash, s::INT AS start_line, least(s + 79, len(l))::INT AS end_line, left(array_to_string(list_slice(l, s, s + 79), chr(10)), 6000) AS text FROM cw),
cn AS (SELECT *, (row_number() OVER (PARTITION BY content_hash ORDER BY start_line) - 1)::INT AS ordinal, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w FROM cc WHERE regexp_matches(text, '\S')),
ch AS (SELECT *, CASE WHEN ordinal = 0 AND len(w) > 0 THEN array_to_string(list_slice(w, 1, 3), ' ') END AS heading, CASE WHEN ordinal = 0 AND len(w) > 0 THEN lower(array_to_string(list_slice(w, 1, 3), ' ')) END AS tokens, content_hash || ':' || ordinal AS chunk_id FROM cn),
ve AS (SELECT md5(d.text) AS content_hash, arg_min(e.embedding, e.vec_id) AS vector FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id GROUP BY 1)"""


def _search_sql(text: str, language: str | None, prefix: str | None, most: int) -> str:
    terms = T.query_terms(text)
    low = text.lower()
    fits = "true" + (f" AND language = '{language}'" if language else "") + (f" AND starts_with(path, '{prefix}')" if prefix else "")
    cos = "list_cosine_similarity(ve.vector::DOUBLE[], q.embedding::DOUBLE[])"
    return f"""WITH {_STORE},
    ss AS ({bm25_sql("sy", "symbol_id", search.SYMBOL_FIELDS, terms, True, None, 9)}), cs AS ({bm25_sql("ch", "chunk_id", search.CHUNK_FIELDS, terms, True, None, 9)}),
    ex AS (SELECT f.path, f.language, sy.*, row_number() OVER (ORDER BY CASE WHEN name = '{text}' THEN 0 WHEN starts_with(lower(name), '{low}') THEN 1 ELSE 2 END, length(name), full_name, path) AS rank FROM f JOIN sy USING (content_hash)
           WHERE (starts_with(lower(name), '{low}') OR starts_with(lower(full_name), '{low}')) AND {fits} QUALIFY rank <= {min(most, 10)}),
    sl AS (SELECT f.path, f.language, sy.*, row_number() OVER (ORDER BY score DESC, name, path) AS rank FROM f JOIN sy USING (content_hash) JOIN ss USING (symbol_id) WHERE {fits} QUALIFY rank <= {2 * most}),
    tl AS (SELECT f.path, f.language, ch.*, row_number() OVER (ORDER BY score DESC, path, start_line) AS rank FROM f JOIN ch USING (content_hash) JOIN cs USING (chunk_id) WHERE {fits} QUALIFY rank <= {2 * most}),
    vl AS (SELECT f.path, f.language, ve.content_hash, row_number() OVER (ORDER BY round({cos}, 9) DESC, path) AS rank FROM f JOIN ve USING (content_hash), (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE round({cos}, 9) > 0.2 AND {fits} QUALIFY rank <= {2 * most}),
    r AS (SELECT 0 AS no, 1.2::DOUBLE AS w, rank, 'sym:' || path || ':' || full_name || ':1' AS key, 'symbol' AS type, path, full_name AS title FROM ex
          UNION ALL SELECT 1, 1.0, rank, 'sym:' || path || ':' || full_name || ':1', 'symbol', path, full_name FROM sl
          UNION ALL SELECT 2, 0.9, rank, 'chunk:' || path || ':' || start_line, 'text', path, coalesce(heading, path || ':' || start_line || '-' || end_line) FROM tl
          UNION ALL SELECT 3, 1.0, rank, 'chunk:' || vl.path || ':' || start_line, 'text', vl.path, coalesce(heading, vl.path || ':' || start_line || '-' || end_line) FROM vl JOIN ch ON ch.content_hash = vl.content_hash AND ch.ordinal = 0),
    fu AS (SELECT key, sum(w / (60 + rank)) AS score, min(no * 100000 + rank) AS seen, arg_min(path, no * 100000 + rank) AS path, arg_min(type, no * 100000 + rank) AS type, arg_min(title, no * 100000 + rank) AS title FROM r GROUP BY key),
    fb AS (SELECT source || '/' || doc_id AS target, len(list_intersect(['the', '{low}'], [event_type, 'the']))::DOUBLE / greatest(2, len(list_distinct(['{low}']))) AS overlap, ts FROM events JOIN documents ON doc_id = user_id ORDER BY ts DESC, event_id DESC LIMIT 1000),
    bo AS (SELECT target, sum(0.012 * (CASE WHEN '{low}' = 'the' THEN 0.5 ELSE 0 END) * pow(0.5, greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts), 0) / 86400e6 / 30)) AS boost FROM fb GROUP BY target),
    sc AS (SELECT key AS id, type, path, title, round_even(score + coalesce(boost, 0), 6) AS score, seen FROM fu LEFT JOIN bo ON path = target)
    SELECT id, type, path, title, score, row_number() OVER (ORDER BY score DESC, seen)::INT AS place FROM sc ORDER BY place LIMIT {most}"""


def _extraction(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A text's first words as its symbol, and its windows of lines; the symbol is the first eight words alone."""
    first = F.element_at("w", 1)
    symbols = contents.select("content_hash", T.first_words(F.col("text"), 8).alias("w")).where(F.size("w") > 0)
    symbols = symbols.select("content_hash", first.alias("name"), F.array_join(F.slice("w", 1, 3), ".").alias("full_name"), F.lit("opening").alias("kind"), F.array_join(F.slice("w", 1, 8), " ").alias("signature"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lower(first).alias("tokens"), F.lit(None).cast("string").alias("doc"))
    chunks = indexing.window_chunks(contents, "content_hash").withColumnRenamed("chunk", "text")
    words = T.first_words(F.col("text"), 3)
    heading = F.when((F.col("ordinal") == 0) & (F.size(words) > 0), F.array_join(words, " "))
    return symbols, chunks.withColumn("heading", heading).withColumn("tokens", F.lower("heading"))


def _indexed(spark, sf_dir) -> Store:
    """The store of the documents as files, with vectors and feedback; indexed where their present files are not yet."""
    path = f"{tables.work_folder(spark)}/index/numbered-store-{tables.version(spark, sf_dir, 'documents')}-{tables.version(spark, sf_dir, 'events')}"
    store = Store.at(spark, path)
    if not tables.exists(spark, f"{path}/_complete"):
        d = tables.load(spark, sf_dir, "documents").where("text is not null")
        snapshot = d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.lit(NOW).alias("modified"), F.col("lang").alias("language"), F.md5("text").alias("content_hash"), "text")
        indexing.index_run(store, "r", "/docs", snapshot, NOW, searchable=True, extraction=_extraction)
        vectors = tables.load(spark, sf_dir, "embeddings").join(d.select(F.col("doc_id").alias("vec_id"), F.md5("text").alias("content_hash")), "vec_id")
        store.write("embeddings", vectors.groupBy("content_hash").agg(F.min_by("embedding", "vec_id").alias("vector")).withColumn("ordinal", F.lit(0)).withColumn("model", F.lit("given")))
        store.write("search_feedback", _feedback(spark, sf_dir).withColumn("repo_id", F.lit("r")).withColumnRenamed("tokens", "query_tokens"))
        spark.range(1).write.mode("overwrite").parquet(f"{path}/_complete")
    return store


def _search(text: str, language: str | None = None, prefix: str | None = None, most: int = 20):
    def run(spark, sf_dir) -> DataFrame:
        asked = tables.load(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
        found = finder.find(_indexed(spark, sf_dir), "r", text, AS_OF, search.Filters(language, prefix), most, asked, "given")
        return found.select("id", "type", "path", "title", "score", "place")

    return run, _search_sql(text, language, prefix, most)


QUERIES["hybrid_search"], ORACLE_SQL["hybrid_search"] = _search("The")
QUERIES["search_code"], ORACLE_SQL["search_code"] = _search("licensed")
QUERIES["search_code_filtered"], ORACLE_SQL["search_code_filtered"] = _search("that", "en", "src1", 10)


def _legs(spark, sf_dir, weighted: bool) -> DataFrame:
    """Rankings of documents by two searches and by likeness to the first vector, 30 each."""
    path = search.index_of(spark, sf_dir, "documents", "doc_id", {"text": 1.0})
    rows = None
    for no, (name, text) in enumerate((("symbols", "license reading"), ("text", "apache license"))):
        one = search.search_index(spark, path, text, "doc_id", False).withColumn("score", F.round("score", 6))
        one = search.ranked(one, [F.desc("score"), "doc_id"], 30).select(F.lit(name).alias("ranking"), F.lit(no).alias("ranking_no"), "rank", F.col("doc_id").alias("key"))
        rows = one if rows is None else rows.unionByName(one)
    e = tables.load(spark, sf_dir, "embeddings")
    near = search.vector_search(e.withColumn("embedding", F.col("embedding")), e.where("vec_id = 0").first()["embedding"], most=30)
    rows = rows.unionByName(near.select(F.lit("vector").alias("ranking"), F.lit(2).alias("ranking_no"), "rank", F.col("vec_id").alias("key")))
    weights = F.create_map(*[F.lit(x) for kv in search.LEG_WEIGHTS.items() for x in kv])
    return rows.withColumn("weight", F.element_at(weights, F.col("ranking")) if weighted else F.lit(1.0))


_LEGS = f"""WITH a AS ({bm25_sql("documents", "doc_id", {"text": 1.0}, T.query_terms("license reading"), False, 30)}), b AS ({bm25_sql("documents", "doc_id", {"text": 1.0}, T.query_terms("apache license"), False, 30)}),
v AS (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE s > 0.2 ORDER BY s DESC, vec_id LIMIT 30),
r AS (SELECT doc_id AS key, 0 AS no, 1.0::DOUBLE AS w, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a UNION ALL SELECT doc_id, 1, 0.9, row_number() OVER (ORDER BY score DESC, doc_id) FROM b UNION ALL SELECT vec_id, 2, 1.0, row_number() OVER (ORDER BY s DESC, vec_id) FROM v),
f AS (SELECT key, sum({{w}} / (60 + rank)) AS score, min(no * 1000 + rank) AS seen FROM r GROUP BY key)"""


@query(_LEGS.replace("{w}", "1.0::DOUBLE") + " SELECT key, round(score, 6) AS score FROM f")
def rrf_fuse(spark, sf_dir):
    return search.fuse(_legs(spark, sf_dir, False)).select("key", F.round("score", 6).alias("score"))


@query(_LEGS.replace("{w}", "w") + " SELECT key, round_even(score, 6) AS score, row_number() OVER (ORDER BY round_even(score, 6) DESC, seen)::INT AS rank FROM f ORDER BY rank LIMIT 20")
def rrf_weights(spark, sf_dir):
    return search.hybrid(_legs(spark, sf_dir, True), spark.createDataFrame([], "key long, boost double"), 20)


@query(f"""WITH b AS (SELECT user_id AS key, sum(0.012 * len(list_intersect(['click', 'home'], [event_type, 'page']))::DOUBLE / 2 * pow(0.5, greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts), 0) / 86400e6 / 30)) AS boost
FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) GROUP BY 1) SELECT key, round(boost, 6) AS boost FROM b""")
def feedback_boost(spark, sf_dir):
    ev = tables.load(spark, sf_dir, "events")
    rows = ev.select(F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", F.lit("page")).alias("tokens"), F.col("user_id").alias("target"), F.col("ts").alias("created_at"))
    return search.feedback_boosts(rows, "click home", AS_OF).select("key", F.round("boost", 6).alias("boost"))


_BASE = _search_sql("licensed", None, None, 20).rpartition("SELECT id, type")[0]


@query(f"""{_BASE.rstrip()}, h AS (SELECT *, row_number() OVER (ORDER BY score DESC, seen) AS p FROM sc), u AS (SELECT id, path FROM h WHERE p = 3),
n AS (SELECT h.id, h.p, h.seen, round(score + CASE WHEN h.id = u.id THEN 0.012 ELSE 0 END + CASE WHEN h.path = u.path THEN 0.012 ELSE 0 END, 6) AS score FROM h, u)
SELECT id, score, row_number() OVER (ORDER BY score DESC, seen)::INT AS place FROM n ORDER BY place LIMIT 20""")
def search_remembered(spark, sf_dir):
    """A search is remembered, its third hit is noted as useful, and the same search then raises this hit and its path."""
    store, asked = _indexed(spark, sf_dir), tables.load(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
    repo, first = uuid.uuid4().hex, uuid.uuid4().hex  # a repository of the same files, whose feedback is its own
    store.put("files", store.read("files").where("repo_id = 'r'").withColumn("repo_id", F.lit(repo)), None, store.next_seq())
    find = lambda **k: finder.find(store, repo, "licensed", AS_OF, vector=asked, model="given", **k)
    find(query_id=first)
    finder.useful(store, first, [3], NOW)
    found = tables.staged(find().select("id", "score", "place"), "again")
    indexing.forget_repository(store, repo)
    return found


@query(f"""WITH {_STORE}, ss AS ({bm25_sql("sy", "symbol_id", search.SYMBOL_FIELDS, T.query_terms("that"), True, None, 9)}),
ex AS (SELECT f.path, sy.*, row_number() OVER (ORDER BY CASE WHEN name = 'that' THEN 0 WHEN starts_with(lower(name), 'that') THEN 1 ELSE 2 END, length(name), full_name, path) AS rank FROM f JOIN sy USING (content_hash) WHERE starts_with(lower(name), 'that') OR starts_with(lower(full_name), 'that') QUALIFY rank <= 30),
sl AS (SELECT f.path, sy.*, row_number() OVER (ORDER BY score DESC, name, path) AS rank FROM f JOIN sy USING (content_hash) JOIN ss USING (symbol_id) QUALIFY rank <= 30),
a AS (SELECT symbol_id, path, full_name, 0 AS leg, rank FROM ex UNION ALL SELECT symbol_id, path, full_name, 1, rank FROM sl)
SELECT symbol_id, path, full_name, leg FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY leg, rank) = 1) ORDER BY leg, rank LIMIT 30""")
def search_symbols(spark, sf_dir):
    """Exact names, then those that full text finds; a symbol of two files is listed once."""
    rows, symbols, by = _files(spark, sf_dir), _symbols(spark, sf_dir), search.Filters()
    scores = search.search_index(spark, _index(spark, sf_dir, "symbols", _symbols, "symbol_id", search.SYMBOL_FIELDS), "that", "symbol_id")
    found = search.search_symbols([search.exact_leg(symbols, rows, "that", by, 30), search.symbol_leg(scores, symbols, rows, by, 30)], 30)
    return found.select("symbol_id", "path", "full_name", "leg")


# --- an index run over two states of the documents ----------------------------------------------------------------


def _snapshot(spark, sf_dir, second: bool) -> DataFrame:
    d = tables.load(spark, sf_dir, "documents").where("doc_id % 7 <> 0" if second else "doc_id % 10 <> 0")
    edited = F.col("doc_id") % 5 == 0
    text = F.when(edited, F.concat("text", F.lit("!"))).otherwise(F.col("text")) if second else F.col("text")
    size = F.when(edited, F.col("n_chars") + 1).when(F.col("doc_id") % 4 == 0, F.col("n_chars") + 2).otherwise(F.col("n_chars")) if second else F.col("n_chars")
    return d.select(F.col("doc_id").cast("string").alias("path"), size.alias("size"), F.timestamp_millis(size * 1000).alias("modified"), F.col("lang").alias("language"), F.md5(text).alias("content_hash"), text.alias("text"))


def _n_chunks(of: str) -> str:
    return f"""(SELECT count(*) FROM (SELECT left(array_to_string(list_slice(l, s, s + 79), chr(10)), 6000) AS c FROM (SELECT l, unnest(range(1, greatest(1, ceil((len(l) - 10) / 70.0)::INT * 70 - 70 + 1) + 1, 70)) AS s FROM (SELECT string_split_regex(text, '\\r?\\n') AS l FROM ({of})))) WHERE regexp_matches(c, '\\S'))"""


@query(f"""WITH o AS (SELECT doc_id, n_chars AS size, md5(text) AS h, text FROM documents WHERE doc_id % 10 <> 0),
n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 WHEN doc_id % 4 = 0 THEN n_chars + 2 ELSE n_chars END AS size, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0),
d AS (SELECT o.h AS oh, n.h AS nh, n.text, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.size = n.size OR o.h = n.h THEN 'unchanged' ELSE 'updated' END AS c FROM o FULL JOIN n USING (doc_id)),
x AS (SELECT count(DISTINCT nh) AS e FROM d WHERE c IN ('added', 'updated') AND nh NOT IN (SELECT h FROM o)),
held AS (SELECT DISTINCT CASE WHEN c = 'unchanged' THEN oh ELSE nh END AS h FROM d WHERE c <> 'removed'), t AS (SELECT h, text FROM o UNION SELECT h, text FROM n)
SELECT 1 AS run, count(*) AS added, 0::BIGINT AS updated, 0::BIGINT AS removed, 0::BIGINT AS unchanged, count(*) - count(DISTINCT h) AS reused, 1 AS generation, count(*) AS file_count, {_n_chunks("SELECT DISTINCT text FROM o")} AS chunk_count FROM o
UNION ALL SELECT 2, count(*) FILTER (c = 'added'), count(*) FILTER (c = 'updated'), count(*) FILTER (c = 'removed'), count(*) FILTER (c = 'unchanged'), count(*) FILTER (c IN ('added', 'updated')) - any_value(e), 2, count(*) FILTER (c <> 'removed'), {_n_chunks("SELECT text FROM t WHERE h IN (SELECT h FROM held)")} FROM d, x""")
def index_run(spark, sf_dir):
    """A store's index brought up to two states of the documents, one after the other."""
    store = Store.at(spark, f"{tables.work_folder(spark)}/store-{uuid.uuid4().hex}")
    first = indexing.index_run(store, "r", "/docs", _snapshot(spark, sf_dir, False), NOW)
    return first.withColumn("run", F.lit(1)).unionByName(indexing.index_run(store, "r", "/docs", _snapshot(spark, sf_dir, True), NOW).withColumn("run", F.lit(2)))


@query("""SELECT 'all files' AS what, count(*) AS files, 0::BIGINT AS updated, count(*) AS fresh FROM documents WHERE doc_id % 10 <> 0
UNION ALL SELECT 'named files', (SELECT count(*) FROM documents WHERE doc_id % 10 <> 0), count(*) FILTER (doc_id % 5 = 0 AND doc_id % 10 <> 0), 0 FROM documents WHERE doc_id IN (1, 3, 5) AND doc_id % 7 <> 0
UNION ALL SELECT 'anew', count(*), 0, count(*) FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT 'forgotten', 0, 0, 0""")
def index_partial_and_anew(spark, sf_dir):
    """Runs of named paths only and of everything anew, and a repository that is forgotten."""
    store = Store.at(spark, f"{tables.work_folder(spark)}/store-{uuid.uuid4().hex}")
    rows = []

    def note(what: str, run: DataFrame) -> None:
        r = run.first()
        rows.append((what, r["file_count"], r["updated"], r["added"]))

    note("all files", indexing.index_run(store, "r", "/docs", _snapshot(spark, sf_dir, False), NOW))
    note("named files", indexing.index_run(store, "r", "/docs", _snapshot(spark, sf_dir, True), NOW, only_paths=["1", "3", "5"]))
    note("anew", indexing.index_run(store, "r", "/docs", _snapshot(spark, sf_dir, True), NOW, force=True))
    indexing.forget_repository(store, "r")
    rows.append(("forgotten", store.read("files").count() + store.read("chunks").count(), 0, 0))
    return spark.createDataFrame(rows, "what string, files long, updated long, fresh long")


@query("""WITH o AS (SELECT doc_id, n_chars AS size FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 WHEN doc_id % 4 = 0 THEN n_chars + 2 ELSE n_chars END AS size FROM documents WHERE doc_id % 7 <> 0),
d AS (SELECT doc_id::VARCHAR AS path FROM o FULL JOIN n USING (doc_id) WHERE o.size IS DISTINCT FROM n.size)
SELECT count(*) > 0 AS stale, count(*) AS changed, array_to_string((SELECT list(path ORDER BY path) FROM (SELECT path FROM d ORDER BY path LIMIT 50)), ',') AS paths, 'scan' AS mode FROM d""")
def index_status(spark, sf_dir):
    return indexing.freshness(_snapshot(spark, sf_dir, False), _snapshot(spark, sf_dir, True), scan_most=1 << 40).withColumn("paths", F.array_join("paths", ","))


@query("""WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0),
k AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 3 <> 0)
SELECT *, missing + mismatched + dangling + orphaned = 0 AS healthy FROM (SELECT (SELECT count(*) FROM o) AS checked, (SELECT count(*) FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)) AS missing, (SELECT count(*) FROM o JOIN n USING (doc_id) WHERE o.h <> n.h) AS mismatched,
(SELECT count(*) FROM o WHERE h NOT IN (SELECT h FROM k)) AS dangling, (SELECT count(*) FROM k WHERE h NOT IN (SELECT h FROM o)) AS orphaned)""")
def verify_index(spark, sf_dir):
    contents = tables.load(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.md5("text").alias("content_hash")).distinct()
    return indexing.verify_index(_snapshot(spark, sf_dir, False), _snapshot(spark, sf_dir, True), contents)


@query("""WITH b AS (SELECT count(*) FILTER (doc_id % 10 = 1) AS missing, count(*) FILTER (doc_id % 10 = 2) AS mismatched, count(DISTINCT CASE WHEN doc_id % 10 NOT IN (1, 2) THEN md5(text) END) AS good FROM documents)
SELECT 'broken' AS state, (SELECT count(*) FROM documents) AS checked, missing, mismatched, (SELECT count(DISTINCT md5(text)) FROM documents) AS contents FROM b
UNION ALL SELECT 'repaired', (SELECT count(*) FROM documents WHERE doc_id % 10 <> 1), 0, 0, (SELECT count(DISTINCT CASE WHEN doc_id % 10 = 2 THEN md5(text || '!') ELSE md5(text) END) FROM documents WHERE doc_id % 10 <> 1) FROM b""")
def verify_repair(spark, sf_dir):
    """A store whose files are gone or other than it says, found out and mended: files, contents and text indexes agree again."""
    d = tables.load(spark, sf_dir, "documents").where("text is not null")
    now = d.where("doc_id % 10 <> 1").withColumn("text", F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    shot = lambda rows: rows.select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(NOW).alias("modified"), F.col("lang").alias("language"), F.md5("text").alias("content_hash"), "text")
    store = Store.at(spark, f"{tables.work_folder(spark)}/store-{uuid.uuid4().hex}")
    indexing.index_run(store, "r", "/docs", shot(d), NOW, searchable=True)
    n = lambda: store.read("contents").count()
    out = [("broken", *indexing.repair(store, "r", "/docs", shot(now), NOW).first()[:3], d.select(F.md5("text")).distinct().count())]
    again = indexing.repair(store, "r", "/docs", shot(now), NOW).first()
    assert again["healthy"]
    out.append(("repaired", *again[:3], n()))
    return spark.createDataFrame(out, "state string, checked long, missing long, mismatched long, contents long")


@query("SELECT 0::BIGINT AS missing, 0::BIGINT AS surplus")
def verify_postings(spark, sf_dir):
    """The stored index of the documents against postings derived from their texts now."""
    path = search.index_of(spark, sf_dir, "documents", "doc_id", {"text": 1.0})
    return indexing.verify_postings(search.stored_postings(spark, path, "doc_id"), search.postings(tables.load(spark, sf_dir, "documents"), "doc_id", {"text": 1.0}), tables.size(spark, f"{path}/postings"))


@query(f"WITH {_STORE} SELECT content_hash, ordinal, 'words' AS model, 64 AS size FROM ch WHERE content_hash NOT IN (SELECT content_hash FROM ve) ORDER BY content_hash, ordinal LIMIT 200")
def embed_batch(spark, sf_dir):
    """Vectors for the next chunks that have none, up to a run's budget."""
    e = tables.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    known = tables.load(spark, sf_dir, "documents").join(e, "doc_id").select(F.md5("text").alias("content_hash")).distinct()
    embedded = _chunks(spark, sf_dir).join(known, "content_hash", "left_semi").select("content_hash", "ordinal", F.lit("words").alias("model"))
    return indexing.embed_batch(_chunks(spark, sf_dir), embedded, "words").select("content_hash", "ordinal", "model", F.size("vector").alias("size"))


@query("SELECT doc_id, left(md5('/srv/' || source || '/' || doc_id), 16) AS repo_id, md5(text) AS content_hash FROM documents")
def repo_identity(spark, sf_dir):
    d = tables.load(spark, sf_dir, "documents")
    return d.select("doc_id", indexing.repo_id(F.concat(F.lit("\\srv\\"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("//"))).alias("repo_id"), indexing.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT path FROM (SELECT regexp_replace(regexp_replace(url, '^\\w+://', ''), '[?#].*$', '') AS path FROM pages) ORDER BY path LIMIT 20".replace("\\\\", "\\"))
def paged_search(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", r"^\w+://", ""), r"[?#].*$", "").alias("path"))
    return files.search_files(rows, "**/*").orderBy("path").limit(20)


# --- notes: a turn of a conversation is a note about two files ----------------------------------------------------


def _notes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(notes, files of their repository)."""
    c = tables.load(spark, sf_dir, "conversations")
    conv = F.col("conv_id").cast("string")
    text = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" token=abcdef123456"))).otherwise(F.col("text"))
    rows = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.lit("r").alias("repo_id"), text.alias("note"), F.array(F.concat(F.lit("/src8/"), conv), F.concat(F.lit("src9\\"), conv), F.concat(F.lit("src8/"), conv)).alias("files"), F.array(F.concat(F.lit(" "), F.upper("role")), F.lit(""), F.col("role")).alias("tags"))
    have = _files(spark, sf_dir).withColumn("repo_id", F.lit("r"))
    return notes.remember(rows, have, NOW), have


_NOTES = f"""f AS (SELECT source || '/' || doc_id AS path, md5(text) AS h FROM documents),
ni AS (SELECT row_number() OVER (ORDER BY conv_id * 100 + turn) AS id, conv_id, role, {redact_sql("CASE WHEN turn % 3 = 0 THEN text || ' token=abcdef123456' ELSE text END")} AS note FROM conversations),
nt AS (SELECT id, role, note, 'src8/' || conv_id AS a, 'src9/' || conv_id AS b, {words_sql("note || ' ' || conv_id || ' ' || conv_id")} AS tokens FROM ni)"""


@query(f"WITH {_NOTES} SELECT id, md5(note) AS digest, a || ',' || b AS files, coalesce(x.h, '') || ',' || coalesce(y.h, '') AS hashes, role AS tags, md5(tokens) AS words FROM nt LEFT JOIN f x ON x.path = a LEFT JOIN f y ON y.path = b")
def note_remember(spark, sf_dir):
    rows, _ = _notes(spark, sf_dir)
    return rows.select("id", F.md5("note").alias("digest"), F.array_join("files", ",").alias("files"), F.array_join("file_hashes", ",").alias("hashes"), F.array_join("tags", ",").alias("tags"), F.md5("tokens").alias("words"))


@query(f"""WITH {_NOTES}, u AS (SELECT user_id + 1 AS id, count(*) AS votes FROM events GROUP BY 1), s AS ({bm25_sql("nt", "id", {"note": 1.0, "tokens": 1.0}, T.query_terms("the license that"), True, None, 9)})
SELECT id, round(score + 0.1 * coalesce(votes, 0), 6) AS score, coalesce(votes, 0)::BIGINT AS useful_count, row_number() OVER (ORDER BY round(score + 0.1 * coalesce(votes, 0), 6) DESC, id DESC)::INT AS place,
 array_to_string(list_sort(list_filter([CASE WHEN a NOT IN (SELECT path FROM f) THEN a END, CASE WHEN b NOT IN (SELECT path FROM f) THEN b END], lambda x: x IS NOT NULL)), ',') AS changed_files,
 NOT (a IN (SELECT path FROM f) AND b IN (SELECT path FROM f)) AS possibly_stale FROM nt JOIN s USING (id) LEFT JOIN u USING (id) WHERE role = 'user' ORDER BY place LIMIT 25""")
def note_recall(spark, sf_dir):
    rows, have = _notes(spark, sf_dir)
    voted = notes.mark_notes_useful(rows, tables.load(spark, sf_dir, "events").select((F.col("user_id") + 1).alias("id")), NOW)
    found = notes.recall(voted, have, "r", "the license that", " USER ", 25)
    return found.select("id", "score", "useful_count", "place", F.array_join("changed_files", ",").alias("changed_files"), "possibly_stale")


@query(ORACLE_SQL["note_recall"])
def note_recall_indexed(spark, sf_dir):
    """What note_recall finds by a scan, from an index of the notes."""
    rows, have = _notes(spark, sf_dir)
    voted = notes.mark_notes_useful(rows, tables.load(spark, sf_dir, "events").select((F.col("user_id") + 1).alias("id")), NOW)
    index = Index(spark, f"{tables.work_folder(spark)}/index/flat-notes-{tables.version(spark, sf_dir, 'conversations')}", "id", notes.FIELDS)
    index.add(rows, segment="all")
    found = notes.recall(voted, have, "r", "the license that", " USER ", 25, index)
    return found.select("id", "score", "useful_count", "place", F.array_join("changed_files", ",").alias("changed_files"), "possibly_stale")


@query(f"""WITH {_NOTES}, u AS (SELECT user_id + 1 AS id, count(*) AS votes FROM events GROUP BY 1) SELECT id, coalesce(votes, 0)::BIGINT AS useful_count, row_number() OVER (ORDER BY coalesce(votes, 0) DESC, coalesce(votes, 0) > 0 DESC, id DESC)::INT AS place
FROM nt LEFT JOIN u USING (id) WHERE id <> 5 ORDER BY place LIMIT 10""")
def note_recall_useful(spark, sf_dir):
    """Without a query the most useful notes; one has been forgotten."""
    rows, have = _notes(spark, sf_dir)
    voted = notes.mark_notes_useful(rows, tables.load(spark, sf_dir, "events").select((F.col("user_id") + 1).alias("id")), NOW)
    return notes.recall(notes.forget(voted, "r", 5), have, "r").select("id", "useful_count", "place")


@query(f"WITH {_NOTES} SELECT id, CASE WHEN id IN (1, 2) THEN 'new,new' ELSE coalesce(x.h, '') || ',' || coalesce(y.h, '') END AS hashes FROM nt LEFT JOIN f x ON x.path = a LEFT JOIN f y ON y.path = b")
def note_repin(spark, sf_dir):
    rows, _ = _notes(spark, sf_dir)
    named = rows.where("id in (1, 2)").select(F.explode("files").alias("path")).distinct().select(F.lit("r").alias("repo_id"), "path", F.lit("new").alias("content_hash"))
    return notes.repin(rows, named, [1, 2], NOW).select("id", F.array_join("file_hashes", ",").alias("hashes"))


@query("""SELECT 'chunk:' || source || '/' || doc_id || ':1' AS target FROM documents UNION ALL SELECT source || '/' || doc_id FROM documents UNION ALL SELECT 'other/' || user_id FROM (SELECT DISTINCT user_id FROM events)""")
def mark_hits_useful(spark, sf_dir):
    """Every document was a hit: even ones are marked by path, odd ones by id; what no hit names is marked as it is."""
    d = tables.load(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")).withColumn("id", F.concat(F.lit("chunk:"), "path", F.lit(":1")))
    asked = spark.createDataFrame([("r", "a b")], "repo_id string, query_tokens string")
    named = d.select(F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise(F.col("id")).alias("target")).unionByName(tables.load(spark, sf_dir, "events").select(F.concat(F.lit("other/"), F.col("user_id").cast("string")).alias("target")))
    return notes.mark_rows_useful(asked, d.select("id", "path"), named, NOW).select("target")


# --- records of what worked: a turn of a conversation is one -------------------------------------------------------


def _inputs(spark, sf_dir) -> DataFrame:
    c = tables.load(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    return c.select(
        (k * 100 + F.col("turn")).alias("seq"), "conv_id", "turn", F.element_at(F.array(F.lit("Worked"), F.lit("failed"), F.lit("partial")), (F.col("turn") % 3 + 1).cast("int")).alias("outcome"),
        F.concat(F.lit(" Use: "), "role", F.lit(" #"), (k % 20).cast("string")).alias("title"), F.col("text").alias("detail"), F.when(k % 4 == 0, F.lit(" ")).otherwise(F.upper("role")).alias("category"),
        F.array(F.col("role"), F.concat(F.lit("T"), (k % 3).cast("string"))).alias("tags"), F.when(k % 3 != 0, F.concat(F.lit("Owner/Repo"), (k % 3).cast("string"))).alias("repo"),
        F.array(F.concat(F.lit("a\\f"), (k % 2).cast("string"), F.lit(".py"))).alias("files"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("tool"), F.when(k % 5 == 0, F.concat(F.lit("P"), (k % 7).cast("string"))).alias("provider"),
        F.lit(None).cast("string").alias("model"), F.when(F.col("turn") == 1, F.left("text", F.lit(20))).alias("evidence"), F.lit("tool").alias("source"), (F.lit(NOW).cast("timestamp") - F.make_dt_interval(hours=k + F.col("turn"))).alias("seen_at"),
    )


_INPUTS = f"""i AS (SELECT conv_id, turn, conv_id * 100 + turn AS seq, role, ['worked', 'failed', 'partial'][turn % 3 + 1] AS outcome, 'Use: ' || role || ' #' || (conv_id % 20) AS title, {redact_sql("trim(text)")} AS detail, CASE WHEN conv_id % 4 = 0 THEN 'general' ELSE lower(role) END AS category,
 CASE WHEN conv_id % 3 <> 0 THEN 'owner/repo' || (conv_id % 3) END AS repo, 'a/f' || (conv_id % 2) || '.py' AS file, CASE WHEN turn % 2 = 0 THEN role END AS tool, CASE WHEN conv_id % 5 = 0 THEN 'p' || (conv_id % 7) END AS provider, TIMESTAMP '{AS_OF}' - to_hours((conv_id + turn)::INT) AS seen_at, 't' || (conv_id % 3) AS tag FROM conversations)"""


def _empty(spark) -> DataFrame:
    return spark.createDataFrame([], Store(spark, "").schemas["learnings"])


@query(f"""WITH {_INPUTS}, o AS (SELECT *, row_number() OVER (ORDER BY conv_id % 2, seq) AS p, outcome || '|' || role || (conv_id % 20) || coalesce(repo, '') || file || coalesce(tool, '') AS fp FROM i),
g AS (SELECT fp, count(*) AS occurrences, arg_min(title, p) AS title, md5(arg_max(detail, length(detail) * 1000000000 - p)) AS detail, arg_max(provider, p) FILTER (provider IS NOT NULL) AS provider, min(conv_id % 2) = 1 AS created, max(seen_at) AS last_seen, min(p) AS first, arg_min(category, p) AS category FROM o GROUP BY fp),
t AS (SELECT fp, array_to_string(list(tag ORDER BY p), ',') AS tags FROM (SELECT fp, tag, min(p * 2 + k) AS p FROM (SELECT fp, p, role AS tag, 0 AS k FROM o UNION ALL SELECT fp, p, tag, 1 FROM o) GROUP BY ALL) GROUP BY fp)
SELECT row_number() OVER (ORDER BY created, first) AS id, occurrences, title, detail, provider, created, last_seen, category, tags FROM g JOIN t USING (fp)""")
def learn_record(spark, sf_dir):
    """Even conversations are recorded into an empty store, then odd ones: new records get the next numbers, repeats are merged."""
    rows = _inputs(spark, sf_dir)
    first = learnings.record(_empty(spark), rows.where("conv_id % 2 = 0")).drop("created")
    found = learnings.record(first, rows.where("conv_id % 2 = 1"))
    return found.select("id", "occurrences", "title", F.md5("detail").alias("detail"), "provider", "created", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "category", F.array_join("tags", ",").alias("tags"))


def _records(spark, sf_dir) -> DataFrame:
    """Each turn as a record of its own, with its number as id."""
    rows = learnings.normalized(_inputs(spark, sf_dir))
    return rows.select(F.col("seq").alias("id"), "outcome", "category", "title", "detail", "tags", "repo", "files", "tool", "provider", F.lower("title").alias("tokens"), (F.col("seq") % 7 + 1).alias("occurrences"), (F.col("seq") % 3).alias("useful"), F.col("seen_at").cast("timestamp_ntz").alias("last_seen"), "evidence")


_RECORDS = f"{_INPUTS}, r AS (SELECT seq AS id, outcome, category, title, detail, role, tag, repo, file, tool, provider, lower(title) AS tokens, seq % 7 + 1 AS occurrences, seq % 3 AS useful, seen_at AS last_seen FROM i)"


@query(f"WITH {_RECORDS} SELECT id FROM r WHERE (repo = 'owner/repo2' OR repo IS NULL) AND outcome = 'worked' AND category = 'user' AND tag = 't0' AND lower(tool) = 'user' AND last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY")
def learn_filters(spark, sf_dir):
    return learnings.filtered(_records(spark, sf_dir), "Owner/Repo2", "worked", "User", "T0", "USER", T.since("2w", NOW)).select("id")


@query(f"WITH {_RECORDS}, s AS ({bm25_sql('r', 'id', {'title': 1.0, 'detail': 1.0, 'tokens': 1.0}, T.query_terms('the license of user'), True, None)}) SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS place FROM r JOIN s USING (id) WHERE repo = 'owner/repo1' OR repo IS NULL ORDER BY place LIMIT 20")
def learn_query_text(spark, sf_dir):
    return learnings.query_learnings(_records(spark, sf_dir), "the license of user", repo="owner/repo1").select("id", "score", "place")


@query(f"""WITH {_RECORDS}, s AS ({bm25_sql('r', 'id', {'title': 1.0, 'detail': 1.0, 'tokens': 1.0}, T.query_terms('apache zebra'), True, None)}),
f AS (SELECT id, row_number() OVER (ORDER BY score DESC, id)::INT AS place FROM r JOIN s USING (id) WHERE repo = 'owner/repo1' OR repo IS NULL ORDER BY place LIMIT 32), n AS (SELECT count(*) AS n FROM f),
x AS (SELECT id, row_number() OVER (ORDER BY last_seen DESC, id)::INT AS place FROM r WHERE repo = 'owner/repo1' OR repo IS NULL ORDER BY place LIMIT 16)
SELECT id, place FROM f UNION ALL SELECT id, (n + place)::INT FROM x, n WHERE n < 8 AND id NOT IN (SELECT id FROM f)""")
def learn_candidates(spark, sf_dir):
    """Records that a task finds, topped up with the latest ones where these are few."""
    return learnings.candidates(_records(spark, sf_dir), "apache", "owner/repo1", ("zebra",), 8).select("id", "place")


_CANDIDATES = ORACLE_SQL["learn_candidates"].rpartition("SELECT id, place FROM f UNION ALL")[0].rstrip()
_CONFIDENCE = f"(1 - 1.0::DOUBLE / (1 + occurrences + useful)) * (0.3 + 0.7 * pow(0.5, greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_seen), 0) / 86400e6 / 90))"


@query(_CANDIDATES + rf""", c AS (SELECT id, place FROM f UNION ALL SELECT id, (n + place)::INT FROM x, n WHERE n < 8 AND id NOT IN (SELECT id FROM f)),
k AS (SELECT r.*, place, concat_ws('|', trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), lower(coalesce(tool, '')), coalesce(repo, '')) AS key FROM c JOIN r USING (id)),
g AS (SELECT *, bool_or(outcome = 'worked') OVER w AND bool_or(outcome = 'failed') OVER w AS conflict, min(place) OVER w AS first, round_even({_CONFIDENCE} * CASE WHEN repo IS NULL THEN 0.8 ELSE 1.0 END, 3) AS confidence,
CASE outcome WHEN 'worked' THEN 'do' WHEN 'failed' THEN 'avoid' ELSE 'caution' END AS advice FROM k WINDOW w AS (PARTITION BY key))
SELECT id, advice, title, conflict, confidence, row_number() OVER (PARTITION BY advice ORDER BY conflict DESC, confidence DESC, first, last_seen DESC, place)::INT AS rank FROM g QUALIFY rank <= 8""")
def learn_recommendations(spark, sf_dir):
    """A task's recommendations from candidates to advice in one chain; the search reads an index of the records."""
    rows = _records(spark, sf_dir)
    index = Index(spark, f"{tables.work_folder(spark)}/index/flat-records-{tables.version(spark, sf_dir, 'conversations')}", "id", learnings.FIELDS)
    index.add(rows, segment="all")
    found = learnings.get_recommendations(rows, AS_OF, "apache", " Owner/Repo1", ("Zebra", "zebra "), 8, index)
    return found.select("id", "advice", "title", "conflict", "confidence", F.col("place").alias("rank"))


@query(ORACLE_SQL["learn_query_text"])
def learn_query_indexed(spark, sf_dir):
    """What learn_query_text finds by a scan, from an index."""
    rows = _records(spark, sf_dir)
    index = Index(spark, f"{tables.work_folder(spark)}/index/flat-records-{tables.version(spark, sf_dir, 'conversations')}", "id", learnings.FIELDS)
    index.add(rows, segment="all")
    return learnings.query_learnings(rows, "the license of user", index=index, repo="owner/repo1").select("id", "score", "place")


@query(f"WITH {_RECORDS} SELECT id, occurrences, useful + CASE WHEN id IN (101, 102) THEN 1 ELSE 0 END AS useful FROM r WHERE id <> 103")
def learn_useful_and_forget(spark, sf_dir):
    rows = learnings.mark_learning_useful(_records(spark, sf_dir), [101, 102, 101])
    return learnings.forget_learning(rows, 103).select("id", "occurrences", "useful")


@query(f"SELECT event_id AS id, event_type AS tool, value > 20 AS worked, {redact_sql("'k ' || user_id || ' password=hunter' || user_id || 'xyz'")} AS note, 'owner/r' || (user_id % 5) AS repo, 'prov' AS provider FROM events")
def record_feedback(spark, sf_dir):
    ev = tables.load(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    rows = ev.select(F.col("event_id").alias("id"), F.concat(F.lit(" "), "event_type").alias("tool"), (F.col("value") > 20).alias("worked"), F.concat(F.lit("k "), user, F.lit(" password=hunter"), user, F.lit("xyz")).alias("note"), F.concat(F.lit("https://github.com/Owner/R"), (F.col("user_id") % 5).cast("string")).alias("repo"), F.lit("Prov ").alias("provider"), F.col("ts").alias("created_at"))
    return learnings.feedback_rows(rows).drop("created_at")


# --- proposals and their dispatch ----------------------------------------------------------------------------------

_LINE = "'- ' || outcome || ' ×' || occurrences || ': ' || title || CASE WHEN coalesce(tool, '') <> '' THEN ' [' || tool || ']' ELSE '' END"
_PROPOSED = f"""{_RECORDS}, m AS (SELECT category, any_value(category) AS c0, count(*) AS n, sum(occurrences)::BIGINT AS corroborations, count(*) FILTER (outcome = 'worked') AS w, count(*) FILTER (outcome = 'failed') AS l FROM r GROUP BY category),
st AS (SELECT category, outcome, title FROM r QUALIFY row_number() OVER (PARTITION BY category ORDER BY occurrences + useful DESC, last_seen DESC, id) = 1),
ru AS (SELECT category, repo FROM (SELECT category, repo, count(*) AS c FROM r WHERE repo IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY category ORDER BY c DESC, repo) = 1),
fi AS (SELECT category, string_agg(file, ',' ORDER BY c DESC, file) AS likely_files FROM (SELECT category, file, count(*) AS c FROM r GROUP BY ALL) GROUP BY category),
li AS (SELECT category, string_agg({_LINE}, chr(10) ORDER BY occurrences DESC, id) AS lines FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY category ORDER BY occurrences DESC, id) <= 10) GROUP BY category),
pr AS (SELECT row_number() OVER (ORDER BY category) AS id, category, coalesce(ru.repo, 'o/default') AS target_repo, CASE WHEN st.outcome = 'failed' THEN 'Prevent' ELSE 'Adopt' END || ' (' || category || '): ' || st.title AS t0, n, corroborations, w, l, likely_files, lines FROM m JOIN st USING (category) LEFT JOIN ru USING (category) JOIN fi USING (category) JOIN li USING (category)),
pp AS (SELECT *, {redact_sql("CASE WHEN length(t0) <= 90 THEN t0 ELSE left(t0, 90) || '…' END")} AS title, n || ' record(s) seen ' || corroborations || ' times (' || w || ' worked, ' || l || ' failed, ' || (n - w - l) || ' partial).' || chr(10) || lines AS rationale FROM pr)"""


def _proposals(spark, sf_dir) -> DataFrame:
    return learnings.create_proposal(_records(spark, sf_dir).withColumn("kind", F.col("category")), "kind", AS_OF, "o/default")


@query(f"WITH {_PROPOSED} SELECT id, category AS kind, 'draft' AS status, target_repo, title, rationale, likely_files, corroborations FROM pp")
def proposal_create(spark, sf_dir):
    return _proposals(spark, sf_dir).select("id", "kind", "status", "target_repo", "title", "rationale", F.array_join("likely_files", ",").alias("likely_files"), "corroborations")


@query(f"""WITH {_PROPOSED} SELECT id, {redact_sql("'Improve ' || target_repo || ' by what earlier tasks have shown.' || chr(10) || chr(10) || '## Goal' || chr(10) || title || chr(10) || chr(10) || '## Why' || chr(10) || rationale || chr(10) || chr(10) || '## Files to look at first' || chr(10) || '- ' || replace(likely_files, ',', chr(10) || '- ') || chr(10) || chr(10) || '## Limits' || chr(10) || '- Change as little as the goal needs, and nothing that it does not need.' || chr(10) || '- Write no credentials.' || chr(10) || '- Open a draft and name the records in it.' || chr(10) || chr(10) || '## Done when' || chr(10) || '- " + (chr(10) + "- ").join(learnings.ACCEPTANCE) + "'")} AS prompt FROM pp""")
def improvement_prompt(spark, sf_dir):
    return _proposals(spark, sf_dir).select("id", "prompt")


@query(f"WITH {_PROPOSED}, r2 AS (SELECT category, string_agg('#' || id, ', ' ORDER BY id) AS ids FROM r GROUP BY category) SELECT pp.id, '# Proposal ' || pp.id || ': ' || title || chr(10) || chr(10) || '- Status: draft' || chr(10) || '- Target: ' || target_repo || chr(10) || '- Corroborations: ' || corroborations || chr(10) || '- Records: ' || ids AS page FROM pp JOIN r2 USING (category)")
def get_proposal(spark, sf_dir):
    page = learnings.proposal_markdown()
    return _proposals(spark, sf_dir).select("id", F.substring_index(page, "\n\nImprove ", 1).alias("page"))


def _orders(spark, sf_dir) -> DataFrame:
    """Orders as proposals."""
    status = F.when(F.col("o_orderstatus") == "P", "draft").when(F.col("o_orderstatus") == "F", "failed").otherwise("dispatched")
    none = F.lit(None).cast("string")
    return tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), none.alias("pr_url"), F.lit("old").alias("last_error"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))


_STATUS = "CASE o_orderstatus WHEN 'P' THEN 'draft' WHEN 'F' THEN 'failed' ELSE 'dispatched' END"


@query(f"SELECT o_orderkey AS id, {_STATUS} AS status FROM orders WHERE {_STATUS} = 'failed' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def list_proposals(spark, sf_dir):
    return learnings.list_proposals(_orders(spark, sf_dir), "failed").select("id", "status")


@query(f"SELECT o_orderkey AS id, CASE WHEN c_custkey IS NOT NULL THEN 'merged' ELSE {_STATUS} END AS status, CASE WHEN c_custkey IS NOT NULL AND c_nationkey % 2 = 0 THEN 'pr/' || c_custkey END AS pr_url, CASE WHEN c_custkey IS NOT NULL THEN NULL ELSE 'old' END AS last_error FROM orders LEFT JOIN customer ON c_custkey = o_orderkey")
def update_proposal_status(spark, sf_dir):
    c = tables.load(spark, sf_dir, "customer")
    changes = c.select(F.col("c_custkey").alias("id"), F.lit("merged").alias("status"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("pr/"), F.col("c_custkey").cast("string"))).alias("pr_url"))
    return learnings.update_proposals(_orders(spark, sf_dir), changes, AS_OF).select("id", "status", "pr_url", "last_error")


@query(f"""WITH d AS (SELECT l_orderkey AS id, count(*) AS n, arg_max(l_shipmode, (l_shipdate, l_linenumber)) AS m FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'webhook' ELSE 'dry-run' END AS l_shipmode FROM lineitem) GROUP BY 1)
SELECT o_orderkey AS id, {_STATUS} AS status, coalesce(n, 0) AS n_dispatches, m AS last_mode FROM orders LEFT JOIN d ON d.id = o_orderkey""")
def dispatch_status(spark, sf_dir):
    li = tables.placed(tables.load(spark, sf_dir, "lineitem"), "seq")
    rows = learnings.dispatch_rows(li.select("seq", F.col("l_linenumber").cast("long").alias("id"), F.col("l_orderkey").alias("proposal_id"), F.when(F.col("l_returnflag") == "R", "webhook").otherwise("dry-run").alias("mode"), F.lit("q").alias("request_id"), F.lit(None).cast("string").alias("external_id"), F.col("l_linestatus").alias("status"), F.lit("sent").alias("detail"), F.col("l_shipdate").alias("created_at")))
    return learnings.dispatch_status(_orders(spark, sf_dir), rows).drop("last_status")


# --- the log in Markdown -------------------------------------------------------------------------------------------


def _logs(spark, sf_dir) -> DataFrame:
    """A log for each user, with an entry for each event: tasks, records, and headings that are neither."""
    ev = tables.load(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "/Build", "error", "/review", "purchase", "learning", "view", "other", "signup", "/squad")]), F.col("event_type"))
    result = F.when(F.col("value") > 20, "Pass").when(F.col("value") > 10, "stopped").otherwise("unclear")
    v = F.col("event_id").cast("string")
    task = F.concat_ws("\n", F.concat(F.lit("- Provider: Acme"), v), F.concat(F.lit("- Result: "), result), F.lit("- Handoff themes: None"), F.concat(F.lit("- Next tweak: "), F.when(F.col("event_id") % 2 == 0, F.lit("None")).otherwise(F.concat(F.lit("try "), v))))
    own = F.concat_ws("\n", F.lit("- Outcome: Failed"), F.lit("- Category: ci"), F.concat(F.lit("- Title: Fix "), v), F.lit("- Detail: Because."), F.lit("- Tags: a, b; c"), F.lit("- Files: None"), F.lit("- Tool: make"), F.lit("- Provider: None"))
    entry = F.concat(F.lit("## "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" — "), kind, F.lit("\n\n"), F.when(kind == "learning", own).otherwise(task))
    return ev.groupBy("user_id").agg(F.concat(F.lit("# Log\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("e")))), lambda x: x["e"]), "\n\n")).alias("text"))


_LOGGED = """l AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS entry, strftime(ts, '%Y-%m-%d') AS date, CASE event_type WHEN 'click' THEN 'squad' WHEN 'error' THEN 'squad-review' WHEN 'signup' THEN 'squad' ELSE 'learning' END AS kind,
 CASE WHEN value > 20 THEN 'pass' WHEN value > 10 THEN 'stopped' ELSE 'unclear' END AS result, event_id, event_type FROM events WHERE event_type <> 'view'),
p AS (SELECT user_id, entry, date, kind, event_id, CASE WHEN kind = 'learning' THEN 'failed' WHEN result = 'pass' THEN 'worked' WHEN result = 'stopped' THEN 'failed' ELSE 'partial' END AS outcome,
 CASE WHEN kind = 'learning' THEN 'Fix ' || event_id ELSE '/' || kind || ' ' || result || CASE WHEN event_id % 2 = 0 THEN ' (' || date || ')' ELSE ': try ' || event_id END END AS title,
 CASE WHEN kind = 'learning' THEN 'a,b,c' ELSE 'squad,' || kind || ',' || result || ',acme' || event_id || ',tier:inherit' END AS tags, CASE WHEN kind = 'learning' THEN 'make' ELSE kind END AS tool, CASE WHEN kind <> 'learning' THEN 'acme' || event_id END AS provider FROM l)"""


@query(f"WITH {_LOGGED} SELECT user_id, entry, date, kind, outcome, title, tags, tool, provider FROM p")
def markdown_log(spark, sf_dir):
    found = learnings.parse_log(_logs(spark, sf_dir), "user_id")
    return found.select("user_id", "entry", "date", "kind", "outcome", "title", F.array_join("tags", ",").alias("tags"), "tool", "provider")


@query(f"WITH {_LOGGED} SELECT count(DISTINCT outcome || '|' || trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || '|' || tool) AS records, 2 * count(*) AS occurrences, 0::BIGINT AS created_again FROM p".replace("\\\\", "\\"))
def import_log(spark, sf_dir):
    """All logs imported twice: the second time only counts. Both imports record the same entries, which are read once."""
    read = learnings.log_records(_logs(spark, sf_dir), "user_id", AS_OF)
    once = learnings.record_folded(_empty(spark), read).drop("created")
    twice = learnings.record_folded(once, read)
    return twice.agg(F.count(F.lit(1)).alias("records"), F.sum("occurrences").alias("occurrences"), F.count_if("created").alias("created_again"))


@query(rf"""WITH {_RECORDS}, e AS (SELECT last_seen, id, '## ' || strftime(last_seen, '%Y-%m-%d') || ' — learning' || chr(10) || chr(10) || '- Outcome: ' || outcome || chr(10) || '- Category: ' || category || chr(10) || '- Title: ' || title || chr(10) || '- Detail: ' || trim(replace(replace(detail, chr(13), ''), chr(10), ' ')) || chr(10)
 || coalesce('- Repo: ' || repo || chr(10), '') || '- Tags: ' || role || ', ' || tag || chr(10) || '- Files: ' || file || chr(10) || '- Tool: ' || coalesce(tool, 'None') || chr(10) || '- Provider: ' || coalesce(provider, 'None') || chr(10) || '- Occurrences: ' || occurrences AS text FROM r ORDER BY last_seen DESC, id LIMIT 1000),
o AS (SELECT text, min((last_seen, id)) AS seen_at FROM e GROUP BY text) SELECT row_number() OVER (ORDER BY seen_at)::INT AS place, md5(trim(text)) AS digest FROM o""")
def export_log(spark, sf_dir):
    rows = _records(spark, sf_dir).drop("evidence").withColumn("evidence", F.lit(None).cast("string"))
    return learnings.export_log(rows).select("place", F.md5("text").alias("digest"))
