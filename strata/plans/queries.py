"""The library's operators as named queries over the test tables, each with the same question in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V
from ..operators import catalog, graph, indexing, learnings, search
from ..sources import files, tables
from ..streaming import streams
from .registry import AS_OF, KEYS, ORACLE_SQL, QUERIES, TOK, bm25_sql, both, query, redact_sql, tok

# --- full text ---------------------------------------------------------------------------------------------------


def _bm25(table: str, key: str, fields: dict[str, float], text: str, prefix: bool, most: int = 20):
    def run(spark, sf_dir) -> DataFrame:
        found = search.search_index(spark, search.index_of(spark, sf_dir, table, key, fields), text, key, prefix)
        return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), key).limit(most)

    return run, bm25_sql(table, key, fields, T.query_terms(text), prefix, most)


for _name, _args in {
    "fts_bm25": ("documents", "doc_id", {"text": 1.0}, "where is the license reading of thing", False),
    "fts_prefix_term": ("documents", "doc_id", {"text": 1.0}, "apache lic", True),
    "fts_stopword_fallback": ("documents", "doc_id", {"text": 1.0}, "the of and", False),
    "fts_weighted_fields": ("part", "p_partkey", {"p_name": 10.0, "p_type": 4.0, "p_brand": 6.0}, "economy widget brand", True),
}.items():
    QUERIES[_name], ORACLE_SQL[_name] = _bm25(*_args)


@query(bm25_sql("documents", "doc_id", {"text": 1.0}, T.query_terms("reading that licence and the license of them"), True, 20))
def fts_scan(spark, sf_dir):
    """The same by a scan, for stores that are searched once."""
    found = search.bm25(tables.load(spark, sf_dir, "documents"), "reading that licence and the license of them", "doc_id", {"text": 1.0})
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"""WITH old AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 0), new AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' maintained' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)
SELECT * FROM ({bm25_sql("new", "doc_id", {"text": 1.0}, T.query_terms("maintained license"), True, 50)})""")
def fts_maintenance(spark, sf_dir):
    """An index of one state of the documents brought to another: kept postings are copied, new texts are read."""
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 10 <> 0")
    new = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" maintained"))).otherwise(F.col("text")))
    base = f"{tables.work_folder(spark)}/index/maintained-{uuid.uuid4().hex}"
    search.write_index(old, f"{base}/old", "doc_id", {"text": 1.0})
    search.update_index(spark, f"{base}/old", f"{base}/new", "doc_id", _changed(old, new), _changed(new, old), {"text": 1.0})
    found = search.search_index(spark, f"{base}/new", "maintained license", "doc_id")
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(50)


def _changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` does not have with the same text."""
    return a.withColumn("h", F.md5("text")).join(b.select("doc_id", F.md5("text").alias("h")), ["doc_id", "h"], "left_anti").select("doc_id", "text")


@query()
def fts_stemmed(spark, sf_dir):
    """English terms by their stems, without diacritics; DuckDB has no stemmer here."""
    path = search.index_of(spark, sf_dir, "documents", "doc_id", {"text": 1.0}, stemmed=True)
    found = search.search_index(spark, path, "licensing readings", "doc_id", prefix_last=False)
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(20)


@query(rf"""
WITH d AS (SELECT doc_id, regexp_split_to_array(text, '\s+') AS p FROM documents WHERE regexp_matches(lower(text), 'licen')),
m AS (SELECT doc_id, p, list_position(list_transform(p, lambda x: len(list_intersect({TOK.format("x")}, ['licensed', 'license'])) > 0), true) AS i FROM d)
SELECT doc_id, CASE WHEN i > 0 THEN array_to_string(list_slice(p, greatest(i - 5, 1), greatest(i - 5, 1) + 39), ' ') END AS snippet FROM m""".replace("lambda x: lower(x)", "lambda y: lower(y)"))
def snippet_first_match(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents").where(F.lower("text").contains("licen"))
    return docs.select("doc_id", search.snippet(F.col("text"), "licensed license").alias("snippet"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct({tok('lower(text)')})), ' ') AS signature FROM documents")
def query_signature(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents").select("doc_id", T.signature(F.col("text")).alias("signature"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query(f"""
WITH t AS (SELECT conv_id, turn, list_distinct({tok('text')}) AS t FROM conversations),
k AS (SELECT conv_id, turn, t, list_filter(t, lambda x: NOT list_contains({_STOP}, x)) AS k FROM t)
SELECT conv_id, turn, array_to_string(list_sort(CASE WHEN len(k) > 0 THEN k ELSE t END), ' ') AS terms FROM k""")
def stopword_terms(spark, sf_dir):
    return tables.load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.terms(F.col("text"))), " ").alias("terms"))


# --- names, vectors, fusion --------------------------------------------------------------------------------------


@query("""
SELECT c_custkey, c_name, CASE WHEN lower(c_name) = 'customer#00000001' THEN 0 WHEN starts_with(lower(c_name), 'customer#00000001') THEN 1 ELSE 2 END AS grade,
       row_number() OVER (ORDER BY grade, length(c_name), c_name)::INT AS rank
FROM customer WHERE starts_with(lower(c_name), 'customer#00000001') ORDER BY rank LIMIT 20""")
def symbol_exact_prefix(spark, sf_dir):
    return search.exact_or_prefix(tables.load(spark, sf_dir, "customer"), "Customer#00000001", "c_name").select("c_custkey", "c_name", "grade", "rank")


def _first_vector(spark, sf_dir) -> list[float]:
    return tables.load(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"""SELECT e.vec_id, round({_COS}, 5) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
WHERE {_COS} > 0.2 ORDER BY {_COS} DESC, e.vec_id LIMIT 10""")
def vector_topk(spark, sf_dir):
    found = search.vector_search(tables.load(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), most=10)
    return found.select("vec_id", F.round("similarity", 5).alias("similarity"))


@query(f"SELECT e.label, count(*) AS n FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_COS} > 0.2 GROUP BY e.label")
def vector_threshold(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in _first_vector(spark, sf_dir)])
    rows = tables.load(spark, sf_dir, "embeddings").where(V.cosine(F.col("embedding"), q) > search.LEAST_SIMILARITY)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, 0.0::DOUBLE AS short, 0.0::DOUBLE AS zero, 0.0::DOUBLE AS missing FROM embeddings")
def vector_mismatch_zero(spark, sf_dir):
    e = F.col("embedding")
    zero = F.transform(e, lambda x: F.lit(0.0).cast("float"))
    return tables.load(spark, sf_dir, "embeddings").select("vec_id", V.cosine(e, F.slice(e, 1, 5)).alias("short"), V.cosine(e, zero).alias("zero"), V.cosine(e, F.lit(None).cast("array<float>")).alias("missing"))


# --- scalars -----------------------------------------------------------------------------------------------------

_SPLIT_ROWS = ("closeLedgerBook", "tax_rate", "XYZGraph7", "harbour", "readCSVRow4b", "IBAN", "v3beta")


@query(f"WITH w AS (SELECT unnest({list(_SPLIT_ROWS)}) AS t UNION" + """ SELECT DISTINCT replace(p_name, ' ', '_') FROM part),
p AS (SELECT t, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([A-Za-z])([0-9])', '\\1_\\2', 'g'), '([A-Za-z])([0-9])', '\\1_\\2', 'g'), '_'), lambda x: x <> '') AS p FROM w)
SELECT t AS token, CASE WHEN len(p) > 1 THEN t || ' ' || lower(array_to_string(p, ' ')) ELSE lower(t) END AS words FROM p""".replace("\\\\", "\\"))
def identifier_split(spark, sf_dir):
    fixed = spark.createDataFrame([(w,) for w in _SPLIT_ROWS], "token string")
    rows = fixed.union(tables.load(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("token"))).distinct()
    return rows.select("token", T.split_identifiers(F.col("token")).alias("words"))


@query(f"SELECT doc_id, md5({redact_sql('text')}) AS digest, {redact_sql('text')} <> text AS changed FROM documents")
def secret_redaction(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("digest"), (T.redact(F.col("text")) != F.col("text")).alias("changed"))


@query(r"""SELECT page_id, lower(CASE WHEN regexp_matches(url, '^[\w.-]+/[\w.-]+$') THEN url ELSE regexp_extract(regexp_replace(url, '[/\\]+$', ''), '([^/\\]*)$', 1) END) AS repo FROM pages""")
def repo_ref_normalize(spark, sf_dir):
    return tables.load(spark, sf_dir, "pages").select("page_id", T.normalize_repo(F.col("url")).alias("repo"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS title FROM conversations")
def title_normalize(spark, sf_dir):
    return tables.load(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_title(F.col("text")).alias("title"))


@query("SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE left(text, 40) || '…' END AS short FROM documents")
def truncate_text(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 40).alias("short"))


# --- extraction and indexing -------------------------------------------------------------------------------------


def _chunks_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""
    WITH d AS (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM documents),
    w AS (SELECT doc_id, l, unnest(range(1, greatest(1, ceil((len(l) - {overlap}) / {step}.0)::INT * {step} - {step} + 1) + 1, {step})) AS s FROM d),
    c AS (SELECT doc_id, s AS start_line, least(s + {size - 1}, len(l)) AS end_line, left(array_to_string(list_slice(l, s, s + {size - 1}), chr(10)), 6000) AS chunk FROM w)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1)::INT AS ordinal, start_line::INT AS start_line, end_line::INT AS end_line, md5(chunk) AS digest
    FROM c WHERE regexp_matches(chunk, '\\S')"""


def _chunks(size: int, overlap: int):
    def run(spark, sf_dir):
        found = indexing.window_chunks(tables.load(spark, sf_dir, "documents"), "doc_id", "text", size, overlap)
        return found.select("doc_id", "ordinal", "start_line", "end_line", F.md5("chunk").alias("digest"))

    return run, _chunks_sql(size, overlap)


QUERIES["window_chunks"], ORACLE_SQL["window_chunks"] = _chunks(80, 10)
QUERIES["chunk_ordinals"], ORACLE_SQL["chunk_ordinals"] = _chunks(10, 2)


@query(r"SELECT doc_id, len(string_split_regex(text, '\r?\n'))::INT AS n_lines, list_max(list_transform(string_split_regex(text, '\r?\n'), lambda x: length(x)))::INT AS longest FROM documents")
def line_stats(spark, sf_dir):
    lines = F.split("text", "\r?\n", -1)
    return tables.load(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("n_lines"), F.array_max(F.transform(lines, lambda x: F.length(x))).alias("longest"))


@query(r"""SELECT page_id, CASE regexp_extract(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1)), '(\.[^.]*)$', 1) WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' ELSE 'text' END AS language FROM pages""")
def language_detect(spark, sf_dir):
    return tables.load(spark, sf_dir, "pages").select("page_id", files.language(F.regexp_replace("url", r"[?#].*$", "")).alias("language"))


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = tables.load(spark, sf_dir, "documents")
    old = docs.where("doc_id % 10 <> 0").select("doc_id", F.col("n_chars").alias("stat"), F.md5("text").alias("digest"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    stat = F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).when(F.col("doc_id") % 4 == 0, F.col("n_chars") + 2).otherwise(F.col("n_chars"))
    return old, docs.where("doc_id % 7 <> 0").select("doc_id", stat.alias("stat"), F.md5(text).alias("digest"))


_SNAP = """WITH o AS (SELECT doc_id, n_chars AS stat, md5(text) AS digest FROM documents WHERE doc_id % 10 <> 0),
n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 WHEN doc_id % 4 = 0 THEN n_chars + 2 ELSE n_chars END AS stat, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS digest FROM documents WHERE doc_id % 7 <> 0)"""


@query(_SNAP + """ SELECT doc_id, CASE WHEN o.digest IS NULL THEN 'added' WHEN n.digest IS NULL THEN 'removed' WHEN o.stat = n.stat THEN 'unchanged' WHEN o.digest = n.digest THEN 'touched' ELSE 'updated' END AS change FROM o FULL JOIN n USING (doc_id)""")
def snapshot_diff(spark, sf_dir):
    return indexing.snapshot_diff(*_snapshots(spark, sf_dir), "doc_id", "stat", "digest")


@query(_SNAP + " SELECT DISTINCT digest, digest IN (SELECT digest FROM o) AS is_known FROM n")
def content_reuse(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return indexing.reused(new, old, "digest")


@query(_SNAP + " SELECT n.doc_id, n.digest FROM n LEFT JOIN o USING (doc_id) WHERE o.digest IS DISTINCT FROM n.digest")
def changed_only(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return new.join(old.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti").select("doc_id", "digest")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans_not_in(spark, sf_dir):
    return indexing.orphans(tables.load(spark, sf_dir, "documents"), tables.load(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT doc_id, quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = l.doc_id)")
def dangling_not_exists(spark, sf_dir):
    return indexing.dangling(tables.load(spark, sf_dir, "labels"), tables.load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id").select("doc_id", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embed_pending(spark, sf_dir):
    vectors = tables.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return indexing.pending(tables.load(spark, sf_dir, "documents"), vectors, ["doc_id"]).select("doc_id")


@query("SELECT count(*) AS total, count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) AS embedded, count(*) FILTER (doc_id NOT IN (SELECT vec_id FROM embeddings)) AS pending FROM documents")
def embed_status(spark, sf_dir):
    vectors = tables.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has"))
    rows = tables.load(spark, sf_dir, "documents").select("doc_id").join(vectors, "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count("has").alias("embedded"), F.count_if(F.col("has").isNull()).alias("pending"))


@query(_SNAP + " SELECT o.doc_id, CASE WHEN n.doc_id IS NULL THEN 'missing' WHEN n.digest = o.digest THEN 'ok' ELSE 'mismatch' END AS state FROM o LEFT JOIN n USING (doc_id)")
def verify_mismatch(spark, sf_dir):
    return indexing.verify(*_snapshots(spark, sf_dir), "doc_id", "digest")


@query(_SNAP + """, p AS (SELECT doc_id - doc_id % 4 AS id, doc_id, digest FROM o)
SELECT id, array_to_string(list_sort(coalesce(list(p.doc_id) FILTER (n.digest IS DISTINCT FROM p.digest), [])), ',') AS stale_files, count(*) FILTER (n.digest IS DISTINCT FROM p.digest) > 0 AS stale
FROM p LEFT JOIN n USING (doc_id) GROUP BY id""")
def note_staleness(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    pins = old.groupBy((F.col("doc_id") - F.col("doc_id") % 4).alias("id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "digest"))).alias("p"))
    notes = pins.select("id", F.col("p.doc_id").alias("files"), F.col("p.digest").alias("file_hashes"))
    return indexing.staleness(notes, new, "doc_id", "digest").withColumn("stale_files", F.array_join("stale_files", ","))


_CO = """WITH r AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS i FROM lineitem), k AS (SELECT c FROM r GROUP BY c HAVING count(*) BETWEEN 2 AND 40), f AS (SELECT r.* FROM r JOIN k USING (c)),
s AS (SELECT i, count(*) AS appearances FROM f GROUP BY i)"""


@query(_CO + " SELECT a, b, together, appearances, round_even(together / appearances, 3) AS confidence FROM (SELECT a.i AS a, b.i AS b, count(*) AS together FROM f a JOIN f b ON a.c = b.c AND a.i <> b.i GROUP BY ALL) JOIN s ON s.i = a")
def cochange_pairs(spark, sf_dir):
    return indexing.cochange_pairs(tables.load(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query(_CO + " SELECT b.i AS b, count(*) AS together, round_even(count(*) / max(s.appearances), 3) AS confidence FROM f a JOIN f b ON a.c = b.c AND a.i <> b.i JOIN s ON s.i = a.i WHERE a.i = 17 GROUP BY b.i ORDER BY together DESC, b LIMIT 15")
def cochange_related(spark, sf_dir):
    lines = tables.load(spark, sf_dir, "lineitem")
    mine = lines.join(lines.where("l_partkey = 17").select("l_orderkey").distinct(), "l_orderkey", "left_semi")
    found = indexing.cochange_pairs(mine, "l_orderkey", "l_partkey").where("a = 17")
    return found.select("b", "together", "confidence").orderBy(F.desc("together"), "b").limit(15)


# --- observation records -----------------------------------------------------------------------------------------


def _records(spark, sf_dir) -> DataFrame:
    """One record for each user and kind of event."""
    ev = tables.load(spark, sf_dir, "events")
    rows = ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("occurrences"), F.max("ts").alias("last_seen"))
    outcome = F.when(F.col("event_type").isin("purchase", "signup"), "worked").when(F.col("event_type") == "error", "failed").otherwise("partial")
    return rows.select(
        (F.col("user_id") * 10 + F.length("event_type")).alias("id"), outcome.alias("outcome"), F.col("event_type").alias("category"),
        F.concat_ws(" ", F.lit("User"), (F.col("user_id") % 40).cast("string")).alias("title"), F.lit("tool").alias("tool"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("o/r"), (F.col("user_id") % 3).cast("string"))).alias("repo"),
        F.array(F.concat(F.lit("f"), (F.col("user_id") % 7).cast("string"))).alias("files"),
        F.col("occurrences"), (F.col("user_id") % 2).alias("useful"), "last_seen",
    )


_REC = """WITH e AS (SELECT user_id, event_type, count(*) AS occurrences, max(ts) AS last_seen FROM events GROUP BY ALL),
r AS (SELECT user_id * 10 + length(event_type) AS id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'worked' WHEN event_type = 'error' THEN 'failed' ELSE 'partial' END AS outcome,
      event_type AS category, 'User ' || (user_id % 40) AS title, CASE WHEN user_id % 3 <> 0 THEN 'o/r' || (user_id % 3) END AS repo, 'f' || (user_id % 7) AS file, occurrences, user_id % 2 AS useful, last_seen FROM e)"""
_CONF = f"(1 - 1.0::DOUBLE / (1 + occurrences + useful)) * (0.3 + 0.7 * pow(0.5, greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_seen), 0) / 86400e6 / 90))"


@query(_REC + f" SELECT id, round_even({_CONF}, 3) AS confidence FROM r")
def confidence_decay(spark, sf_dir):
    c = learnings.confidence(F.col("occurrences"), F.col("useful"), F.col("last_seen"), F.lit(AS_OF))
    return _records(spark, sf_dir).select("id", F.bround(c, 3).alias("confidence"))


_KEYED = ", k AS (SELECT *, bool_or(outcome = 'worked') OVER w AND bool_or(outcome = 'failed') OVER w AS conflict FROM r WHERE {where} WINDOW w AS (PARTITION BY title, repo))"


@query(_REC + _KEYED.format(where="repo = 'o/r1' OR repo IS NULL") + f""", s AS (SELECT id, CASE outcome WHEN 'worked' THEN 'do' WHEN 'failed' THEN 'avoid' ELSE 'caution' END AS advice, conflict,
round_even({_CONF} * CASE WHEN repo IS NULL THEN 0.8 ELSE 1.0 END, 3) AS confidence FROM k)
SELECT *, row_number() OVER (PARTITION BY advice ORDER BY conflict DESC, confidence DESC, id)::INT AS place FROM s QUALIFY place <= 5""")
def recommend_do_avoid(spark, sf_dir):
    return learnings.recommend(_records(spark, sf_dir), AS_OF, "o/r1", 5)


@query(_REC + _KEYED.format(where="true") + " SELECT id, conflict FROM k")
def conflict_flags(spark, sf_dir):
    return learnings.conflicts(_records(spark, sf_dir)).select("id", "conflict")


@query("""WITH r AS (SELECT *, md5(concat_ws(chr(10), lower(event_type), trim(regexp_replace(lower('User ' || (user_id % 20)), '[^\\p{L}\\p{N}]+', ' ', 'g')), '', 'a/b.cs', '')) AS fingerprint, substr(props, 1, 6 + event_id % 5) AS detail FROM events)
SELECT fingerprint, count(*) AS occurrences, arg_min('User #' || (user_id % 20), event_id) AS title, arg_max(detail, length(detail) * 1000000000 - event_id) AS detail,
       array_to_string(list_sort(list_distinct(list('t' || (event_id % 3)))), ',') AS tags, max(ts) AS last_seen FROM r GROUP BY fingerprint""".replace("\\\\", "\\"))
def learn_dedup_merge(spark, sf_dir):
    ev = tables.load(spark, sf_dir, "events")
    title = F.concat(F.lit("User #"), (F.col("user_id") % 20).cast("string"))
    fp = learnings.fingerprint(F.col("event_type"), title, F.lit(None).cast("string"), F.array(F.lit("a\\b.cs")), F.lit(None).cast("string"))
    detail = F.substring(F.col("props"), F.lit(1), (F.lit(6) + F.col("event_id") % 5).cast("int"))
    rows = ev.select(fp.alias("fingerprint"), F.col("event_id").alias("seq"), title.alias("title"), detail.alias("detail"), F.array(F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string"))).alias("tags"), F.lit(None).cast("string").alias("provider"), F.col("ts").alias("seen_at"))
    return learnings.merge_records(rows).drop("provider").withColumn("tags", F.array_join(F.array_sort("tags"), ","))


@query(_REC + f" SELECT id, category FROM r WHERE (repo = 'o/r2' OR repo IS NULL) AND outcome = 'failed' AND last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY ORDER BY last_seen DESC, id LIMIT 20")
def learn_query_filter(spark, sf_dir):
    since = F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 3 DAYS")
    rows = _records(spark, sf_dir).where(learnings.in_repo(F.col("repo"), "o/r2") & (F.col("outcome") == "failed") & (F.col("last_seen") >= since))
    return rows.orderBy(F.desc("last_seen"), "id").limit(20).select("id", "category")


@query("SELECT event_type AS tool, count(*) FILTER (value > 20) AS n_worked, count(*) FILTER (value <= 20) AS n_failed, max(ts) AS last_at FROM events GROUP BY 1")
def feedback_summary(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), (F.col("value") > 20).alias("worked"), F.col("ts").alias("at"))
    return learnings.feedback_summary(rows)


@query(_REC + f""", f AS (SELECT * FROM r WHERE last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)
SELECT 'outcome' AS section, outcome AS name, count(*) AS n FROM f GROUP BY outcome UNION ALL SELECT 'category', category, count(*) FROM f GROUP BY category UNION ALL SELECT 'ready', 'all', count(*) FROM f WHERE occurrences >= 3
UNION ALL (SELECT 'corroborated', id::VARCHAR, (occurrences + useful)::BIGINT FROM f ORDER BY occurrences + useful DESC, id LIMIT 10)
UNION ALL SELECT 'failed tool', event_type, count(*) FROM events WHERE value <= 20 AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY event_type
UNION ALL SELECT 'proposal', CASE o_orderstatus WHEN 'P' THEN 'draft' WHEN 'F' THEN 'failed' ELSE 'dispatched' END, count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 2""")
def summarize_period(spark, sf_dir):
    since = F.lit(T.since("7d", _at(AS_OF)).isoformat(" ")).cast("timestamp_ntz")
    fed = tables.load(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), (F.col("value") > 20).alias("worked"), F.col("ts").alias("at"))
    made = tables.load(spark, sf_dir, "orders").select(_status().alias("status"), F.col("o_orderdate").alias("created_at"))
    return learnings.summarize(_records(spark, sf_dir), since, fed, made)


def _at(text: str):
    import datetime as dt

    return dt.datetime.fromisoformat(text)


def _status():
    return F.when(F.col("o_orderstatus") == "P", "draft").when(F.col("o_orderstatus") == "F", "failed").otherwise("dispatched")


@query(_REC + """, p AS (SELECT CASE o_orderstatus WHEN 'P' THEN 'draft' WHEN 'F' THEN 'failed' ELSE 'dispatched' END AS status FROM orders)
SELECT a.*, b.* FROM (SELECT count(*) AS total, count(*) FILTER (outcome = 'worked') AS worked, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'partial') AS partial FROM r) a,
(SELECT count(*) FILTER (status = 'draft') AS proposals_draft, count(*) FILTER (status = 'dispatched') AS proposals_dispatched, 0::BIGINT AS proposals_pr_opened, 0::BIGINT AS proposals_merged, 0::BIGINT AS proposals_rejected, count(*) FILTER (status = 'failed') AS proposals_failed FROM p) b""")
def learn_stats(spark, sf_dir):
    return learnings.stats(_records(spark, sf_dir), tables.load(spark, sf_dir, "orders").select(_status().alias("status")))


@query(_REC + """, c AS (SELECT title, category, count(*) AS c FROM r GROUP BY ALL), t AS (SELECT title, file, row_number() OVER (PARTITION BY title ORDER BY count(*) DESC, file) AS p FROM r GROUP BY title, file)
SELECT title, count(*) AS n, sum(occurrences)::BIGINT AS corroborations, count(*) FILTER (outcome = 'worked') AS n_worked, count(*) FILTER (outcome = 'failed') AS n_failed,
 (SELECT category FROM c WHERE c.title = r.title ORDER BY c DESC, category LIMIT 1) AS category, (SELECT string_agg(file, ',' ORDER BY p) FROM t WHERE t.title = r.title AND p <= 12) AS likely_files FROM r GROUP BY title""")
def proposal_rollup(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("g", F.col("title"))
    return learnings.proposal(rows, "g").drop("title").withColumnRenamed("g", "title").withColumn("likely_files", F.array_join("likely_files", ","))


@query("""WITH d AS (SELECT count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 DAY AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND event_type <> 'error' AND event_type = 'signup')
SELECT o_orderkey, corroborations FROM (SELECT o_orderkey, o_orderkey % 6 AS corroborations, CASE o_orderstatus WHEN 'P' THEN 'draft' WHEN 'F' THEN 'failed' ELSE 'sent' END AS status FROM orders), d WHERE status IN ('draft', 'failed') AND corroborations >= 3 AND d.n < 1000""")
def dispatch_eligible(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "P", "draft").when(F.col("o_orderstatus") == "F", "failed").otherwise("sent")
    asked = tables.load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).alias("corroborations"), status.alias("status"))
    sent = tables.load(spark, sf_dir, "events").select(F.col("ts").alias("created_at"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.when(F.col("event_type") == "signup", "send").otherwise("dry-run").alias("mode"))
    return learnings.dispatchable(asked, sent, "2024-01-20 12:00:00", a_day=1000).select("o_orderkey", "corroborations")


# --- metadata and the SQL surface --------------------------------------------------------------------------------


_TYPES = "CASE WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'int' WHEN data_type = 'DOUBLE' THEN 'double' WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' WHEN data_type LIKE 'FLOAT[%' THEN 'array<float>' ELSE lower(data_type) END"
_NAMED = "(" + ", ".join(f"'{t}'" for t in KEYS) + ")"


def _database(sf_dir: str) -> catalog.Database:
    return catalog.folder_database("test", sf_dir)


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", 'table' AS type, count(*) AS n_rows FROM {t}" for t in KEYS))
def list_tables(spark, sf_dir):
    return catalog.list_tables(spark, _database(sf_dir)).drop("schema")


@query('SELECT \'orders\' AS "table", \'table\' AS type, count(*) AS n_rows FROM orders')
def list_tables_search(spark, sf_dir):
    return catalog.list_tables(spark, _database(sf_dir), "ORDER").drop("schema")


def _described_sql(name: str) -> str:
    primary, foreign = KEYS[name]
    refs = " ".join(f"WHEN '{c}' THEN '{t}.{k}'" for c, (t, k) in foreign.items())
    listed = ", ".join(f"'{c}'" for c in primary)
    return f"""SELECT table_name AS "table", ordinal_position::INT AS ordinal, column_name AS "column", {_TYPES} AS type, true AS nullable, column_name IN ({listed}) AS primary_key, {f"CASE column_name {refs} END" if refs else "NULL::VARCHAR"} AS "references"
    FROM information_schema.columns WHERE table_name = '{name}'"""


@query(_described_sql("lineitem"))
def describe_table(spark, sf_dir):
    return catalog.describe(spark, _database(sf_dir), "lineitem", KEYS)


@query(" UNION ALL ".join(f"""SELECT "table", 'table' AS type, string_agg("column" || ' ' || type || CASE WHEN primary_key THEN ' PK' ELSE '' END, ', ' ORDER BY ordinal) AS columns, coalesce(string_agg("column" || ' -> ' || "references", ', ' ORDER BY ordinal), '') AS "references", NULL::VARCHAR AS error FROM ({_described_sql(t)}) GROUP BY 1""" for t in KEYS))
def schema_overview(spark, sf_dir):
    return catalog.overview(spark, _database(sf_dir), KEYS).withColumn("columns", F.array_join("columns", ", ")).withColumn("references", F.array_join("references", ", "))


@query("""SELECT 'bad' AS alias, 'parquet' AS engine, false AS reachable UNION ALL SELECT 'main', 'parquet', true""")
def list_databases(spark, sf_dir):
    found = catalog.Registry()
    found.add_spec(f"main=parquet:{sf_dir}")
    found.add_spec(f"bad=parquet:{sf_dir}/no-such-folder")
    return found.listing(spark).select("alias", "engine", "reachable")


@query(r"SELECT event_id, regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '(\.\d*?)0+$', '\1'), '\.$', '') AS ts, base64(encode(event_type)) AS kind, value, value > 50 AS high FROM events".replace("\\", chr(92)))
def value_rendering(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "events").select("event_id", "ts", F.encode("event_type", "utf-8").alias("kind"), "value", (F.col("value") > 50).alias("high"))
    return catalog.rendered(rows)


@query("SELECT doc_id, CASE WHEN octet_length(encode(repeat(text, 4))) > 65536 THEN '<' || octet_length(encode(repeat(text, 4))) || ' bytes>' ELSE md5(base64(encode(repeat(text, 4)))) END AS shown FROM documents")
def binary_rendering(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "documents").select("doc_id", F.encode(F.repeat("text", 4), "utf-8").alias("shown"))
    return catalog.rendered(rows).withColumn("shown", F.when(F.col("shown").startswith("<"), F.col("shown")).otherwise(F.md5("shown")))


@query(r"SELECT c_custkey, 'Host=db' || c_custkey || ';Password=***;User=' || c_name AS connection FROM customer")
def connection_redaction(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "customer")
    return catalog.redacted(rows.select("c_custkey", F.concat(F.lit("Host=db"), F.col("c_custkey").cast("string"), F.lit(";Password=p w"), F.col("c_custkey").cast("string"), F.lit(";User="), F.col("c_name")).alias("connection")), "connection")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def write_query_count(spark, sf_dir):
    """Rows that a guarded INSERT says it wrote to a table of the warehouse, which is dropped again."""
    tables.register(spark, sf_dir)
    name = f"written_{uuid.uuid4().hex}"
    catalog.write_query(spark, f"CREATE TABLE {name} (k BIGINT) USING parquet", read_only=False)
    n = catalog.write_query(spark, f"INSERT INTO {name} SELECT o_orderkey FROM orders WHERE o_orderstatus = @status", {"status": "F"}, read_only=False)
    catalog.write_query(spark, f"DROP TABLE {name}", read_only=False)
    return spark.createDataFrame([(n,)], "n long")


@query("""SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM customer WHERE c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 5000) > 20 AS truncated FROM customer WHERE c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 5000 ORDER BY c_custkey LIMIT 20""")
def read_query_params(spark, sf_dir):
    tables.register(spark, sf_dir)
    return catalog.read_query(spark, "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = @seg AND c_acctbal > @least ORDER BY c_custkey;", {"seg": "HOUSEHOLD", "least": 5000}, 20)


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer) > 200 AS truncated FROM customer ORDER BY c_custkey LIMIT 200")
def row_cap_truncated(spark, sf_dir):
    return files.capped(tables.load(spark, sf_dir, "customer").orderBy("c_custkey"), 200).select("c_custkey", "c_name", "truncated")


@query("SELECT c_custkey, c_name, count(*) OVER () AS total, CASE WHEN count(*) OVER () > 150 THEN to_base64(encode('o:150')) END AS next_token FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def page_offset(spark, sf_dir):
    return catalog.page(tables.load(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], catalog.page_token(100))


@query('''SELECT 0::BIGINT AS line_no, 'r_regionkey,note,missing' AS line UNION ALL
SELECT row_number() OVER (ORDER BY r_regionkey), r_regionkey || ',"' || r_name || ', ""x""",' FROM region''')
def export_csv(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "region").select("r_regionkey", F.concat("r_name", F.lit(', "x"')).alias("note"), F.lit(None).cast("string").alias("missing"))
    return catalog.csv_lines(rows, ["r_regionkey"])


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json FROM nation""")
def export_json(spark, sf_dir):
    return catalog.json_rows(tables.load(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("x")))


# --- listings and summaries --------------------------------------------------------------------------------------


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def first_per_group(spark, sf_dir):
    return tables.load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"), F.min_by("o_totalprice", "o_orderkey").alias("o_totalprice"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders QUALIFY place <= 3")
def topk_per_group(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return tables.load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", place.alias("place")).where("place <= 3")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_high, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 30")
def diag_by_id(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.count_distinct("user_id").alias("n_users"))
    return rows.orderBy(F.desc("n"), "event_type").limit(30)


@query("SELECT event_id, event_type FROM events WHERE CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END >= 3")
def severity_threshold(spark, sf_dir):
    grades = F.create_map(*[x for i, t in enumerate(("view", "click", "signup", "purchase", "error")) for x in (F.lit(t), F.lit(i))])
    return tables.load(spark, sf_dir, "events").where(F.element_at(grades, F.col("event_type")) >= 3).select("event_id", "event_type")


# --- graphs ------------------------------------------------------------------------------------------------------


def _edges(spark, sf_dir) -> DataFrame:
    """Customers to nations to regions, and suppliers to nations."""
    n, c, s = (tables.load(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    a = n.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))
    b = c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
    return a.unionByName(b).unionByName(s.select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst")))


_EDGES = """e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""


@query(f"""WITH RECURSIVE {_EDGES}, w(node, level) AS (SELECT 'c5', 0 UNION SELECT e.dst, level + 1 FROM w JOIN e ON e.src = w.node WHERE level < 3)
SELECT node, min(level)::INT AS level FROM w GROUP BY node""")
def graph_bfs_depth3(spark, sf_dir):
    return graph.levels(_edges(spark, sf_dir), spark.createDataFrame([("c5",)], "node string"), 3)


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(node, level) AS (SELECT 'c7', 0 UNION SELECT b.dst, level + 1 FROM w JOIN b ON b.src = w.node WHERE level < 4)
SELECT node, min(level)::INT AS level FROM w WHERE node <> 'c7' GROUP BY node""")
def graph_closure(spark, sf_dir):
    """All that is linked to a customer, over edges both ways: many paths and cycles lead to each node."""
    edges = _edges(spark, sf_dir)
    both_ways = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.closure(both_ways, spark.createDataFrame([("c7",)], "node string"))


def _sales(spark, sf_dir) -> DataFrame:
    """An edge for each line of an order, from its customer to its supplier, named region.nation.key."""
    li, o, c, s, n = (tables.load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    named = lambda p, key, nation: n.select(F.col("n_nationkey").alias(nation), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".n"), F.col("n_nationkey").cast("string"), F.lit(f".{p}")).alias(f"{p}_place"))
    buys = c.join(named("c", "c_custkey", "c_nationkey"), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), F.concat("c_place", F.col("c_custkey").cast("string")).alias("src"))
    sells = s.join(named("s", "s_suppkey", "s_nationkey"), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), F.concat("s_place", F.col("s_suppkey").cast("string")).alias("dst"))
    return li.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(o.select("o_orderkey", "o_custkey"), "o_orderkey").join(buys, "o_custkey").join(sells, "l_suppkey").select("src", "dst")


_SALES = """sales AS (SELECT 'r' || a.n_regionkey || '.n' || a.n_nationkey || '.c' || c_custkey AS src, 'r' || b.n_regionkey || '.n' || b.n_nationkey || '.s' || s_suppkey AS dst
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation b ON s_nationkey = b.n_nationkey)"""


@query(f"""WITH RECURSIVE {_SALES}, e AS (SELECT DISTINCT split_part(src, '.', 1) AS src, split_part(dst, '.', 1) AS dst FROM sales), p(start, path, last) AS (SELECT src, [src, dst], dst FROM e WHERE dst > src
UNION ALL SELECT start, list_append(path, e.dst), e.dst FROM p JOIN e ON e.src = p.last WHERE len(path) < 12 AND e.dst > start AND NOT list_contains(path, e.dst))
SELECT length, array_to_string(nodes, ',') AS nodes FROM (SELECT DISTINCT len(path)::INT AS length, list_sort(path) AS nodes FROM p JOIN e ON e.src = p.last AND e.dst = p.start ORDER BY nodes LIMIT 25)""")
def graph_cycles(spark, sf_dir):
    """Cycles of regions that sell to one another: names are cut at their first part."""
    return graph.cycles(graph.folded(_sales(spark, sf_dir), 1)).withColumn("nodes", F.array_join("nodes", ","))


@query(f"WITH {_SALES}, f AS (SELECT split_part(src, '.', 1) || '.' || split_part(src, '.', 2) AS src, split_part(dst, '.', 1) || '.' || split_part(dst, '.', 2) AS dst FROM sales) SELECT src, dst, count(*) AS n FROM f WHERE src <> dst GROUP BY ALL")
def namespace_edges(spark, sf_dir):
    return graph.edge_counts(graph.folded(_sales(spark, sf_dir), 2))


@query(f"WITH {_SALES}, f AS (SELECT split_part(src, '.', 1) || '.' || split_part(src, '.', 2) AS src, split_part(dst, '.', 1) || '.' || split_part(dst, '.', 2) AS dst FROM sales) SELECT src, count(DISTINCT dst) AS n_targets, count(*) AS n_edges FROM f WHERE src <> dst GROUP BY src ORDER BY n_targets DESC, src LIMIT 20")
def namespace_fan_out(spark, sf_dir):
    return graph.fan_out(graph.folded(_sales(spark, sf_dir), 2))


_AROUND = f"""WITH RECURSIVE {_EDGES}, o(node, level) AS (SELECT 'n3', 0 UNION SELECT e.dst, level + 1 FROM o JOIN e ON e.src = o.node WHERE level < 2), i(node, level) AS (SELECT 'n3', 0 UNION SELECT e.src, level + 1 FROM i JOIN e ON e.dst = i.node WHERE level < 2),
nodes AS (SELECT node, 'out' AS direction, min(level)::INT AS level FROM o GROUP BY node HAVING min(level) > 0 UNION ALL SELECT node, 'in', min(level)::INT FROM i GROUP BY node HAVING min(level) > 0 UNION ALL SELECT 'n3', 'start', 0),
few AS (SELECT * FROM nodes ORDER BY level, direction, node LIMIT 500)"""


@query(_AROUND + " SELECT node, direction, level FROM few")
def call_graph_nodes(spark, sf_dir):
    return graph.call_graph(_edges(spark, sf_dir), spark.createDataFrame([("n3",)], "node string"), 2)[0].select("node", "direction", "level")


@query(_AROUND + " SELECT src, dst, count(*) AS n_sites FROM e WHERE src IN (SELECT node FROM few) AND dst IN (SELECT node FROM few) GROUP BY ALL")
def call_graph_edges(spark, sf_dir):
    return graph.call_graph(_edges(spark, sf_dir), spark.createDataFrame([("n3",)], "node string"), 2)[1]


@query(f"""WITH RECURSIVE {_EDGES}, up(node, level) AS (SELECT dst, 1 FROM e WHERE src = 'n7' UNION SELECT e.dst, level + 1 FROM up JOIN e ON e.src = up.node)
SELECT 'ancestor' AS relation, node, min(level)::INT AS level FROM up GROUP BY node UNION ALL SELECT DISTINCT 'descendant', src, 1 FROM e WHERE dst = 'n7'""")
def type_hierarchy(spark, sf_dir):
    """What a nation is part of or supplied by, and its customers, as a type's ancestors and what derives from it."""
    return graph.hierarchy(_edges(spark, sf_dir).select(F.col("src").alias("child"), F.col("dst").alias("parent")), "n7")


@query("SELECT DISTINCT 'c' || c_custkey AS node, 2 AS level FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1")
def type_implementations(spark, sf_dir):
    return graph.implementations(_edges(spark, sf_dir).select(F.col("src").alias("child"), F.col("dst").alias("parent")), "r1")


@query(f"WITH {_EDGES} SELECT src, count(DISTINCT dst) AS n_targets, count(*) AS n_edges FROM e WHERE src <> dst GROUP BY src ORDER BY n_targets DESC, src LIMIT 20")
def graph_fanout(spark, sf_dir):
    return graph.fan_out(_edges(spark, sf_dir), 20)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def unused_nodes(spark, sf_dir):
    edges = tables.load(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return graph.unused(tables.load(spark, sf_dir, "customer").select("c_custkey"), edges, "c_custkey")


@query("SELECT l_partkey AS dst, l_suppkey AS src, count(*) AS n_sites, array_to_string(list_sort(list(l_orderkey)), ',') AS sites FROM lineitem GROUP BY ALL")
def graph_callers(spark, sf_dir):
    return graph.callers(tables.load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("dst"), F.col("l_suppkey").alias("src"), F.col("l_orderkey").alias("site"))).withColumn("sites", F.array_join("sites", ","))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def manifest_left_anti(spark, sf_dir):
    return tables.load(spark, sf_dir, "part").join(tables.load(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


# --- files -------------------------------------------------------------------------------------------------------


def _paths(spark, sf_dir) -> DataFrame:
    return tables.load(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", r"^\w+://", ""), r"[?#].*$", "").alias("path"))


_PATHS = r"(SELECT page_id, regexp_replace(regexp_replace(url, '^\w+://', ''), '[?#].*$', '') AS path FROM pages)"


@query(rf"SELECT page_id, path FROM {_PATHS} WHERE regexp_matches(lower(path), '^(?:.*/)?[^/]*en[^/]*$') AND NOT regexp_matches(lower(path), '^(?:.*/)?[^/]*\.html$')")
def glob_search(spark, sf_dir):
    return files.search_files(_paths(spark, sf_dir), "en", ("**/*.html",))


#: Paths of a page by its number, whether rules leave them out; the last has what the user's rules say.
_KINDS = (("src/p{}.py", False), ("node_modules/p{}/index.js", True), ("conf/.env.p{}", True), ("certs/s{}.pem", True), ("img/{}.png", True), ("generated/M{}.cs", True), ("src/F{}.g.cs", True), ("src/keep{}.g.cs", False), ("docs/private{}.md", True), ("other/docs/private{}.md", False))


@query("SELECT page_id, CASE page_id % 10 " + " ".join(f"WHEN {i} THEN {str(out).lower()}" for i, (_, out) in enumerate(_KINDS)) + " END AS ignored FROM pages")
def ignore_rules(spark, sf_dir):
    path = F.element_at(F.array(*[F.lit(p) for p, _ in _KINDS]), (F.col("page_id") % 10 + 1).cast("int"))
    rows = tables.load(spark, sf_dir, "pages").select("page_id", F.replace(path, F.lit("{}"), F.col("page_id").cast("string")).alias("path"))
    return rows.select("page_id", files.ignored(F.col("path"), ("# comment", "generated/", "*.g.cs", "!keep*.g.cs", "/docs/private*.md")).alias("ignored"))


@query(f"""WITH p AS (SELECT string_split(path, '/') AS s FROM {_PATHS}), l AS (SELECT s, unnest(range(1, len(s) + 1)) AS level FROM p)
SELECT array_to_string(list_slice(s, 1, level), '/') AS entry, level::INT AS level, CASE WHEN level = len(s) THEN 'file' ELSE 'dir' END AS kind, count(*) AS n_files FROM l WHERE level <= 2 GROUP BY ALL ORDER BY entry, kind LIMIT 5000""".replace("count(*) AS n_files", "count(*) AS n_files, count(*) OVER () > 5000 AS truncated"))
def tree_levels(spark, sf_dir):
    return files.tree(_paths(spark, sf_dir), "path", 2)


@query("""SELECT DISTINCT 'src/P' || l_partkey || '.cs' AS file, l_linenumber AS line, CASE l_returnflag WHEN 'R' THEN 'error' ELSE 'warning' END AS severity, 'CS' || l_suppkey AS code, 'status ' || l_linestatus AS message FROM lineitem WHERE l_returnflag <> 'N'""")
def parse_log_lines(spark, sf_dir):
    """Compiler output made of order lines, a text for each order, with lines that are none and lines that repeat."""
    li = tables.load(spark, sf_dir, "lineitem")
    at = F.concat(F.lit("src/P"), F.col("l_partkey").cast("string"), F.lit(".cs("), F.col("l_linenumber").cast("string"))
    line = F.concat(at, F.lit(",5): "), F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "N", "note").otherwise("warning"), F.lit(" CS"), F.col("l_suppkey").cast("string"), F.lit(": status "), F.col("l_linestatus"), F.lit(" [/x/P.csproj]"))
    texts = li.withColumn("line", line).groupBy("l_orderkey").agg(F.array_join(F.collect_list("line"), "\nBuild continues.\n").alias("text"))
    return files.build_lines(texts.unionByName(texts))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 2), chr(10)) AS head, array_to_string(list_slice(string_split(text, chr(10)), greatest(len(string_split(text, chr(10))) - 1, 1), 1000000), chr(10)) AS tail FROM documents")
def text_head_tail(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents").select("doc_id", files.head_tail(F.col("text"), head=2).alias("head"), files.head_tail(F.col("text"), tail=2).alias("tail"))


# --- what a pass-through must answer -----------------------------------------------------------------------------

both("sql_inner_join", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 400000")
both("sql_left_join", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000 GROUP BY c.c_custkey")
both("sql_full_join", "SELECT coalesce(a.doc_id, b.vec_id) AS id, a.quality, b.label FROM labels a FULL JOIN embeddings b ON a.doc_id = b.vec_id")
both("sql_right_join", "SELECT d.doc_id, d.lang, l.quality FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
both("sql_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
both("sql_composite_join", "SELECT a.conv_id, a.turn, b.role AS answered_by, length(b.text) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn JOIN documents d ON d.doc_id = a.conv_id WHERE a.role = 'user'")
both("sql_range_join", "SELECT b.lo, count(*) AS n, round(sum(c.c_acctbal), 2) AS total FROM customer c JOIN (SELECT r_regionkey * 2200 - 1000 AS lo, r_regionkey * 2200 + 1200 AS hi FROM region) b ON c.c_acctbal >= b.lo AND c.c_acctbal < b.hi GROUP BY b.lo")
both("sql_interval_join", "SELECT a.event_id AS bought, count(*) AS views FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 2 DAY WHERE a.event_type = 'purchase' AND b.event_type = 'view' GROUP BY a.event_id", "SELECT a.event_id AS bought, count(*) AS views FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 2 DAYS WHERE a.event_type = 'purchase' AND b.event_type = 'view' GROUP BY a.event_id")
both("sql_exists_correlated", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS large FROM customer")
both("sql_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
both("sql_anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.08)")
both("sql_theta_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
both("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("sql_rollup_having", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type) HAVING count(*) > 3")
both("sql_distinct_aggregates", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag")
both("sql_ranks", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
both("sql_frames", "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events")
both("sql_set_operations", "(SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 9) UNION ALL (SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier)")
both("sql_union_all_distinct", "SELECT lang AS v FROM documents UNION SELECT event_type FROM events UNION SELECT role FROM conversations")
both("sql_recursive", "WITH RECURSIVE y(y, last) AS (SELECT year(min(o_orderdate))::INT, year(max(o_orderdate))::INT FROM orders UNION ALL SELECT y + 1, last FROM y WHERE y < last) SELECT y.y, count(o_orderkey) AS n FROM y LEFT JOIN orders ON year(o_orderdate) = y.y GROUP BY y.y", "WITH RECURSIVE y(y, last) AS (SELECT year(min(o_orderdate)), year(max(o_orderdate)) FROM orders UNION ALL SELECT y + 1, last FROM y WHERE y < last) SELECT y.y, count(o_orderkey) AS n FROM y LEFT JOIN orders ON year(o_orderdate) = y.y GROUP BY y.y")
both("sql_lateral_unnest", "SELECT o_orderkey, unnest(a) AS x, (generate_subscripts(a, 1) - 1)::INT AS pos FROM (SELECT o_orderkey, string_split(o_orderpriority, '-') AS a FROM orders)", "SELECT o_orderkey, x, pos FROM orders LATERAL VIEW posexplode(split(o_orderpriority, '-')) t AS pos, x")
both("sql_json", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type", "SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type")
both("sql_pivot", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey", "SELECT o_custkey, coalesce(f, 0) AS f, coalesce(o, 0) AS o, coalesce(p, 0) AS p FROM (SELECT o_custkey, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))")
both("sql_subqueries", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT 1.6 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)")
both("sql_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS d, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS d, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
both("sql_dates", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, datediff('day', TIMESTAMP '1995-01-01', o_orderdate)::INT AS d FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, datediff(o_orderdate, DATE '1995-01-01') AS d FROM orders")
both("sql_modes_and_quantiles", "SELECT l_linestatus, mode(l_returnflag) AS m, round(quantile_cont(l_quantity, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90, round(stddev_samp(l_discount), 6) AS sd FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, mode(l_returnflag) AS m, round(percentile(l_quantity, 0.5), 4) AS q50, round(percentile(l_extendedprice, 0.9), 4) AS q90, round(stddev_samp(l_discount), 6) AS sd FROM lineitem GROUP BY l_linestatus")
both("sql_approximate", "SELECT l_returnflag, abs(approx_count_distinct(l_orderkey) - count(DISTINCT l_orderkey)) < 0.25 * count(DISTINCT l_orderkey) AS near FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, abs(approx_count_distinct(l_orderkey) - count(DISTINCT l_orderkey)) < 0.25 * count(DISTINCT l_orderkey) AS near FROM lineitem GROUP BY l_returnflag")


@query("SELECT e.event_id, arg_max(p.event_id, p.ts) AS before FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'view' AND p.ts <= e.ts WHERE e.event_type = 'purchase' GROUP BY e.event_id")
def sql_asof(spark, sf_dir):
    """The last view before each purchase of a user: one window over both, no join of ranges."""
    ev = tables.load(spark, sf_dir, "events")
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", F.col("event_type") != "view").rowsBetween(Window.unboundedPreceding, 0))
    return ev.select("event_id", "event_type", last.alias("before")).where("event_type = 'purchase' and before is not null").select("event_id", "before")


# --- streams: batch forms, and replays of events as files, one late and one twice -----------------------------------

_SESSIONS = """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s)
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 2 HOUR AS finish, count(*) AS n FROM g GROUP BY user_id, g"""
_ROLLING = """SELECT b AS begin, b + INTERVAL 24 HOUR AS finish, count(*) AS n FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts), INTERVAL 6 HOUR)) AS b FROM events) GROUP BY b"""
#: How late rows of the replay may come, and who sends the event that ends it.
_LATE, _NOBODY = "90 days", -1


@query(_SESSIONS)
def debounce_batch(spark, sf_dir):
    return streams.debounced(tables.load(spark, sf_dir, "events"), "user_id", "ts", "2 hours")


@query(_ROLLING)
def rolling_cap_batch(spark, sf_dir):
    return streams.rolling(tables.load(spark, sf_dir, "events"), "ts", "24 hours", "6 hours")


def _replay(spark, sf_dir) -> tuple[DataFrame, str]:
    """(a stream of all events in four files that come out of order, one of them twice, and an event that lets all windows end, a folder)."""
    ev = tables.load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    part = F.pmod(F.dayofyear("ts") * 4 / 31, F.lit(4)).cast("int")
    end = ev.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).select(F.lit(_NOBODY).cast("long").alias("event_id"), "ts", F.lit(_NOBODY).cast("long").alias("user_id"), F.lit("end").alias("event_type"))
    folder, schema = streams.replayed(ev, 4, part, end)
    return streams.watch(spark, folder, schema, 1), folder


def _ntz(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in rows.dtypes])


@query(_SESSIONS)
def stream_debounce(spark, sf_dir):
    events, folder = _replay(spark, sf_dir)
    once = streams.deduplicated(events, ["event_id"], "ts", _LATE)
    found = streams.run_now(streams.debounced(once, "user_id", "ts", "2 hours", None), f"{folder}-out", f"{folder}-at")
    return _ntz(found.where(F.col("user_id") != _NOBODY))


@query(_ROLLING)
def stream_rolling_cap(spark, sf_dir):
    events, folder = _replay(spark, sf_dir)
    once = streams.deduplicated(events, ["event_id"], "ts", _LATE)
    found = streams.run_now(streams.rolling(once, "ts", "24 hours", "6 hours", None), f"{folder}-out", f"{folder}-at")
    return _ntz(found)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    events, folder = _replay(spark, sf_dir)
    found = streams.run_now(streams.deduplicated(events, ["user_id", "event_type"], "ts", _LATE).select("user_id", "event_type"), f"{folder}-out", f"{folder}-at")
    return found.where(F.col("user_id") != _NOBODY)


@query("SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark, sf_dir):
    events, folder = _replay(spark, sf_dir)
    streams.upsert_stream(events.select("event_id", "user_id", "ts"), f"{folder}-table", ["user_id"], ["ts", "event_id"], f"{folder}-at")
    return _ntz(streams.latest(spark, f"{folder}-table").where(F.col("user_id") != _NOBODY).select("event_id", "user_id", "ts"))


@query(f"SELECT user_id, round(sum(value * pow(0.5, greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts), 0) / 86400e6 / 30)), 6) AS total FROM events GROUP BY user_id")
def decayed_sum(spark, sf_dir):
    return streams.decayed(tables.load(spark, sf_dir, "events"), "user_id", "ts", "value", AS_OF, 30.0).withColumn("total", F.round("total", 6))


from . import code_queries, fulltext, join_queries, knowledge, reference_queries, stream_queries  # noqa: E402, F401  they register theirs
