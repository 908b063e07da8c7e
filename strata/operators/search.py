"""Retrieval and ranking: weighted BM25 by scan or from a stored index, name matches, vectors, fusion by reciprocal rank,
and the search over symbols, chunks and vectors that puts them together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V
from ..functions.stem import stem
from ..sources import tables
from .words import blocks_of, each_posting, each_term, own_terms, term_blocks

#: Fixed values of the ranking contract.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K = 60
LEG_WEIGHTS = {"exact": 1.2, "symbols": 1.0, "text": 0.9, "vector": 1.0}
LEAST_SIMILARITY = 0.2
BOOST, HALF_LIFE_DAYS, FEEDBACK_ROWS = 0.012, 30.0, 1000


#: Fixed values of the ranking contract: weights of the fields of symbols and of chunks.
SYMBOL_FIELDS = {"name": 10.0, "full_name": 4.0, "signature": 1.0, "doc": 1.0, "tokens": 6.0}
CHUNK_FIELDS = {"heading": 4.0, "text": 1.0, "tokens": 3.0}


def _weighted(words: Column, weight: float) -> Column:
    return F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(float(weight)).alias("weight")))


def postings(docs: DataFrame, key: str, fields: dict[str, float], stemmed: bool = False) -> DataFrame:
    """(key, length, term, tf): the words of all fields and weighted term frequency, one pass over the texts and no shuffle.

    ``stemmed`` folds diacritics and stems English terms.
    """
    return each_term(own_terms(docs, key, fields, stemmed=stemmed), key)


def _write_postings(rows: DataFrame, held: int, path: str, files: int | None = None) -> None:
    """Write blocks of postings, ``held`` bytes of Parquet, in order of terms."""
    spark, first = rows.sparkSession, F.col("keys")[0]
    ranged = rows.repartitionByRange(*((files,) if files else tables.parts(spark, held)), "term", first)
    ranged.sortWithinPartitions("term", first).write.option("parquet.block.size", 8 << 20).mode("overwrite").parquet(f"{path}/postings")


def stored_postings(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(term, key, length, tf) of the index at ``path``."""
    return each_posting(spark.read.parquet(f"{path}/postings"), key)


def write_index(docs: DataFrame, path: str, key: str, fields: dict[str, float], stemmed: bool = False, files: int | None = None) -> None:
    """Write postings in order of terms, the texts' lengths, and statistics.

    Files and row groups hold ranges of terms, so a search reads those of its terms by their footers; a frequent
    term goes over several files, as the ranges are over term and key. Texts are read once; what is shuffled is a row for
    each block of a term's postings.
    """
    made = tables.staged(term_blocks(docs, key, fields, stemmed=stemmed), "words")
    own, blocks = _kinds(made)
    stats = own.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"), F.lit(stemmed).alias("stemmed"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    own.select(key, "length").write.mode("overwrite").parquet(f"{path}/lengths")
    _write_postings(blocks, tables.size(docs.sparkSession, made.staged_at), path, files)
    tables.drop(made)


def _kinds(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows and the blocks of term_blocks()."""
    return made.where("term is null"), made.where("term is not null").select("term", "keys", "lengths", "tfs")


def _length(fields: dict[str, float]) -> Column:
    out = F.lit(0)
    for f in fields:
        out = out + F.size(T.tokens(F.col(f)))
    return out


def update_index(spark: SparkSession, path: str, target: str, key: str, removed: DataFrame, added: DataFrame, fields: dict[str, float]) -> None:
    """Write to ``target`` the index at ``path`` without the keys of ``removed`` and with the texts of ``added``, which may share keys.

    Only added texts are read; kept postings are copied. Statistics follow from counts and lengths.
    """
    stats = spark.read.parquet(f"{path}/stats").first()
    old, lengths = stored_postings(spark, path, key), spark.read.parquet(f"{path}/lengths")
    out = tables.staged(removed.select(key).distinct(), "removed")
    made = tables.staged(term_blocks(added, key, fields, stemmed=stats["stemmed"]), "words")
    own, blocks = _kinds(made)
    sums = lambda rows: rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
    minus, plus = sums(lengths.join(out, key, "left_semi")), sums(own)
    n = stats["n_docs"] - minus["n"] + plus["n"]
    words = round((stats["mean_length"] or 0.0) * stats["n_docs"]) - minus["words"] + plus["words"]
    spark.createDataFrame([(n, words / n if n else None, stats["stemmed"])], "n_docs long, mean_length double, stemmed boolean").coalesce(1).write.mode("overwrite").parquet(f"{target}/stats")
    lengths.join(out, key, "left_anti").unionByName(own.select(key, "length")).write.mode("overwrite").parquet(f"{target}/lengths")
    held = tables.size(spark, f"{path}/postings") + tables.size(spark, made.staged_at)
    kept = tables.staged(blocks_of(old.join(out, key, "left_anti"), key).select(*blocks.columns), "kept")
    _write_postings(kept.unionByName(blocks), held, target)
    tables.drop(out, made, kept)


def search_index(spark: SparkSession, path: str, query: str, key: str, prefix_last: bool = True) -> DataFrame:
    """(key, score) as bm25() gives, from the index at ``path``: only postings of the query's terms are read."""
    stats = spark.read.parquet(f"{path}/stats")
    blocks = spark.read.parquet(f"{path}/postings")
    terms = T.query_terms(query)
    if stats.first()["stemmed"]:
        terms = list(dict.fromkeys(stem(_plain(t)) for t in terms))
    if not terms:
        return each_posting(blocks, key).select(key, F.lit(0.0).alias("score")).limit(0)
    hits = None
    for i, t in enumerate(terms):
        hit = F.col("term").startswith(t) if prefix_last and i == len(terms) - 1 else F.col("term") == t
        hits = hit if hits is None else hits | hit
    found = each_posting(blocks.where(hits), key).withColumn("phrase", F.explode(_phrases(F.col("term"), terms, prefix_last)))
    tf = found.groupBy(key, "length", "phrase").agg(F.sum("tf").alias("tf"))
    return _scored(tf, stats, key)


def _plain(term: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c))


def index_of(spark: SparkSession, folder: str, table: str, key: str, fields: dict[str, float], stemmed: bool = False) -> str:
    """The path of a table's index in the session's shared folder; made where the table's present files have none yet."""
    name = "-".join(["blocks", table, *fields, "stemmed" if stemmed else "plain", tables.version(spark, folder, table)])
    path = f"{tables.work_folder(spark)}/index/{name}"
    if not tables.exists(spark, f"{path}/postings/_SUCCESS"):
        write_index(tables.load(spark, folder, table), path, key, fields, stemmed)
    return path


def _phrases(word: Column, terms: list[str], prefix_last: bool) -> Column:
    """The places of the query's terms that a word stands for."""
    places = [F.when(word.startswith(t) if prefix_last and i == len(terms) - 1 else word == t, F.lit(i)) for i, t in enumerate(terms)]
    return F.array_compact(F.array(*places))


def _scored(tf: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """(key, score) of term frequencies (key, length, phrase, tf) with statistics (n_docs, mean_length)."""
    df = tf.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the query
    joined = tf.join(F.broadcast(df), "phrase").crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return joined.groupBy(key).agg(F.sum(part).alias("score"))


def bm25(docs: DataFrame, query: str, key: str, fields: dict[str, float], prefix_last: bool = True) -> DataFrame:
    """(key, score) of all rows that match a term of the query, by a scan of the texts; for stores that are searched once.

    Terms are OR-ed and the last one is a prefix: one phrase whose frequencies are summed over its expansions.
    Statistics are those of the whole store. A weight multiplies a field's term frequencies before saturation.
    Words that no term asks for are dropped before anything is shuffled.
    """
    terms = T.query_terms(query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(_length(fields)).alias("mean_length"))
    each = F.concat(*[_weighted(T.tokens(F.col(f)), w) for f, w in fields.items()])
    hits = docs.select(F.col(key), _length(fields).alias("length"), F.filter(each, lambda w: F.size(_phrases(w["term"], terms, prefix_last)) > 0).alias("ws"))
    hits = hits.select(key, "length", F.explode("ws").alias("w")).select(key, "length", F.explode(_phrases(F.col("w.term"), terms, prefix_last)).alias("phrase"), "w.weight")
    return _scored(hits.groupBy(key, "length", "phrase").agg(F.sum("weight").alias("tf")), stats, key)


def snippet(text: Column, query: str, words: int = 40) -> Column:
    """Up to ``words`` words from the first match on; null without a match."""
    terms = T.query_terms(query)
    parts = F.split(text, r"\s+")
    hit = lambda w: F.arrays_overlap(T.tokens(w), F.array(*map(F.lit, terms)))
    at = F.array_min(F.filter(F.transform(parts, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull()))
    return F.when(at.isNotNull(), F.array_join(F.slice(parts, F.greatest(at - 5, F.lit(0)) + 1, words), " "))


def exact_or_prefix(df: DataFrame, query: str, name: str, full_name: str | None = None, most: int = 20) -> DataFrame:
    """Rows whose name begins with the query in any case: equal ones first, then by length and name; with ``rank``."""
    q = query.lower()
    full_name = full_name or name
    low, full = F.lower(F.col(name)), F.lower(F.col(full_name))
    grade = F.when((low == q) | (full == q), 0).when(low.startswith(q), 1).otherwise(2)
    rows = df.where(low.startswith(q) | full.startswith(q)).withColumn("grade", grade)
    order = ["grade", F.length(F.col(full_name)), F.col(full_name)]
    return ranked(rows, order, most)


def ranked(df: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows of an order, with rank from 1; the limit comes before the rank, so the rank sees few rows."""
    return df.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def vector_search(df: DataFrame, query: list[float], vector: str = "embedding", floor: float = LEAST_SIMILARITY, most: int = 20, tie: str = "vec_id") -> DataFrame:
    """The most similar rows above a floor, with similarity and rank; a scan and a top-k, no shuffle of vectors."""
    like = V.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    rows = df.withColumn("similarity", like).where(F.col("similarity") > floor)
    return ranked(rows, [F.desc("similarity"), F.col(tie)], most)


def fuse(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(key, score, ranks) of long rankings (ranking, ranking_no, weight, rank, key), in order of ``position``.

    Score: sum of weight / (k + rank), with a key that a ranking lists twice counted twice; ranks maps each
    ranking to the key's least rank. Ties go to the key first seen, in the order of rankings, then ranks.
    """
    rows = rankings.groupBy("key", "ranking").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("part"), F.min("rank").alias("rank"), F.min(F.struct("ranking_no", "rank")).alias("seen"))
    listed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("ranking", "rank"))))
    out = rows.groupBy("key").agg(F.sum("part").alias("score"), listed.alias("ranks"), F.min("seen").alias("seen"))
    return out


def feedback_boosts(feedback: DataFrame, query: str, as_of: str, latest: int = FEEDBACK_ROWS) -> DataFrame:
    """(key, boost) from past queries (tokens, target, created_at, id): overlap with this query, halved each 30 days."""
    tokens = sorted(set(T.query_tokens(query)))
    mine = F.array(*map(F.lit, tokens)).cast("array<string>")
    rows = feedback.orderBy(F.desc("created_at"), F.desc("id")).limit(latest)
    past = F.array_distinct(F.filter(F.split("tokens", " "), lambda t: t != ""))
    shared = F.size(F.array_intersect(past, mine))
    overlap = shared / F.greatest(F.size(past), F.size(mine), F.lit(1))
    days = F.greatest((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86400e6, F.lit(0.0))
    return rows.select(F.col("target").alias("key"), (BOOST * overlap * F.pow(F.lit(0.5), days / HALF_LIFE_DAYS)).alias("b")).groupBy("key").agg(F.sum("b").alias("boost"))


def hybrid(rankings: DataFrame, boosts: DataFrame, most: int = 20) -> DataFrame:
    """Fused scores with boosts, rounded half to even at six digits, then ordered by the rounded score."""
    fused = fuse(rankings).join(boosts, "key", "left")
    score = F.bround(F.col("score") + F.coalesce("boost", F.lit(0.0)), 6)
    return ranked(fused.withColumn("score", score), [F.desc("score"), F.col("seen")], most).select("key", "score", "rank")


@dataclass(frozen=True)
class Filters:
    """What a search is restricted to: a language, a beginning of the path and, for symbols only, a kind."""

    language: str | None = None
    path_prefix: str | None = None
    kind: str | None = None

    def apply(self, rows: DataFrame, kinds: bool = False) -> DataFrame:
        if self.language and self.language.strip():
            rows = rows.where(F.col("language") == self.language.strip().lower())
        if self.path_prefix and self.path_prefix.strip():
            rows = rows.where(F.col("path").startswith(self.path_prefix.replace("\\", "/").strip("/")))
        if kinds and self.kind and self.kind.strip():
            rows = rows.where(F.col("kind") == self.kind.strip().lower())
        return rows


_HIT = ("id", "type", "path", "language", "start_line", "end_line", "title", "detail", "snippet")


def symbol_hits(rows: DataFrame) -> DataFrame:
    """Symbols of files as hits: identified by path, full name and line."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("*", F.concat_ws(":", F.lit("sym"), "path", "full_name", F.col("start_line").cast("string")).alias("id"), F.lit("symbol").alias("type"), F.col("full_name").alias("title"), F.concat(F.col("kind"), F.lit(": "), text(F.col("signature"))).alias("detail"), text(F.col("doc")).alias("snippet"))


def chunk_hits(rows: DataFrame, snippets: Column) -> DataFrame:
    """Chunks of files as hits: identified by path and line; the title is the heading, or path and lines."""
    where = F.format_string("%s:%d-%d", "path", "start_line", "end_line")
    return rows.select("*", F.concat_ws(":", F.lit("chunk"), "path", F.col("start_line").cast("string")).alias("id"), F.lit("text").alias("type"), F.coalesce("heading", where).alias("title"), F.lit(None).cast("string").alias("detail"), snippets.alias("snippet"))


def exact_leg(symbols: DataFrame, files: DataFrame, query: str, filters: Filters, most: int) -> DataFrame:
    """Symbols whose name or full name begins with the query, as ranked hits, one for each file that has them."""
    rows = filters.apply(files.join(symbols, "content_hash"), kinds=True)
    low = query.strip().lower()
    name, full = F.lower("name"), F.lower("full_name")
    grade = F.when(F.col("name") == query.strip(), 0).when(name.startswith(low), 1).otherwise(2)
    rows = rows.where(name.startswith(low) | full.startswith(low)).withColumn("grade", grade)
    return symbol_hits(ranked(rows, ["grade", F.length("name"), "full_name", "path", "start_line"], most))


def symbol_leg(scores: DataFrame, symbols: DataFrame, files: DataFrame, filters: Filters, most: int) -> DataFrame:
    """Symbols (symbol_id) in order of their scores, as ranked hits."""
    rows = filters.apply(files.join(symbols.join(scores, "symbol_id"), "content_hash"), kinds=True)
    return symbol_hits(ranked(rows.withColumn("score", F.round("score", 9)), [F.desc("score"), "name", "path", "start_line"], most))


def chunk_leg(scores: DataFrame, chunks: DataFrame, files: DataFrame, query: str, filters: Filters, most: int) -> DataFrame:
    """Chunks (chunk_id) in order of their scores, as ranked hits with a snippet from the first match on."""
    rows = filters.apply(files.join(chunks.join(scores, "chunk_id"), "content_hash"))
    top = ranked(rows.withColumn("score", F.round("score", 9)), [F.desc("score"), "path", "start_line"], most)
    return chunk_hits(top, F.coalesce(snippet(F.col("text"), query), F.lit("")))


def vector_leg(vectors: DataFrame, chunks: DataFrame, files: DataFrame, query: list[float], filters: Filters, most: int) -> DataFrame:
    """Chunks in order of the similarity of their vectors (content_hash, ordinal, vector), as ranked hits; the prefix of a path is taken as it is given."""
    like = V.cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
    near = vectors.select("content_hash", "ordinal", F.round(like, 9).alias("similarity")).where(F.col("similarity") > LEAST_SIMILARITY)
    rows = files.join(near, "content_hash")
    rows = Filters(filters.language).apply(rows)
    rows = rows.where(F.col("path").startswith(filters.path_prefix)) if filters.path_prefix else rows
    top = ranked(rows, [F.desc("similarity"), "path", "ordinal"], most)
    met = top.join(chunks, ["content_hash", "ordinal"])
    return chunk_hits(met, F.when(F.length("text") > 400, F.concat(F.left("text", F.lit(400)), F.lit("\u2026"))).otherwise(F.col("text")))


def search_code(legs: dict[str, DataFrame], boosts: DataFrame, most: int = 20) -> DataFrame:
    """The hits of up to four legs (exact, symbols, text, vector) fused: _HIT columns, score, ranks and place.

    Boosts (key, boost) count for a hit's path and for its id. A hit that several legs give is shown as the first of
    them has it. Ties go to the hit that was seen first, in order of legs, then ranks.
    """
    rows = None
    for no, name in enumerate(LEG_WEIGHTS):
        if name in legs:
            one = legs[name].select(F.lit(name).alias("ranking"), F.lit(no).alias("ranking_no"), F.lit(LEG_WEIGHTS[name]).alias("weight"), "rank", F.col("id").alias("key"), F.struct(*_HIT).alias("hit"))
            rows = one if rows is None else rows.unionByName(one)
    fused = fuse(rows.drop("hit"))
    shown = rows.groupBy("key").agg(F.min_by("hit", F.struct("ranking_no", "rank")).alias("hit"))
    met = fused.join(shown, "key").select("key", "score", "ranks", "seen", "hit.*")
    by = lambda c: boosts.select(F.col("key").alias(c), F.col("boost").alias(f"_{c}"))
    met = met.join(by("path"), "path", "left").join(by("id"), "id", "left")
    score = F.bround(F.col("score") + F.coalesce("_path", F.lit(0.0)) + F.coalesce("_id", F.lit(0.0)), 6)
    top = ranked(met.withColumn("score", score), [F.desc("score"), "seen"], most)
    return top.select(*_HIT, "score", "ranks", F.col("rank").alias("place"))


def remembered(hits: DataFrame, query_id: str, repo_id: str, query: str, at: str) -> DataFrame:
    """A row of queries: what a search gave, for feedback on it."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "path"))), lambda x: F.struct(x["id"].alias("id"), x["path"].alias("path")))
    return hits.agg(listed.alias("hits")).select(F.lit(query_id).alias("query_id"), F.lit(repo_id).alias("repo_id"), F.lit(" ".join(sorted(set(T.query_tokens(query))))).alias("query_tokens"), "hits", F.lit(at).cast("timestamp").alias("at"))


def search_symbols(legs: list[DataFrame], most: int = 30) -> DataFrame:
    """Symbols of several legs, one after another, each symbol_id once with its first place, at most ``most``."""
    rows = None
    for no, leg in enumerate(legs):
        one = leg.withColumn("leg", F.lit(no))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    once = rows.withColumn("_p", F.row_number().over(Window.partitionBy("symbol_id").orderBy("leg", "rank"))).where("_p = 1").drop("_p")
    return once.orderBy("leg", "rank").limit(most)
