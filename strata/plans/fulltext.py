"""Queries over the positional index of the documents: dictionary, phrases, cover density, snippets, segments."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import inverted, search
from ..sources import tables
from .registry import bm25_sql, query, tok

FIELDS = ("title", "text")
CLASSES = {"title": "A", "text": "C"}


def _titled(spark, sf_dir) -> DataFrame:
    """The documents with their first five words as title."""
    return tables.load(spark, sf_dir, "documents").select("doc_id", F.array_join(T.first_words(F.col("text"), 5), " ").alias("title"), "text")


def _index(spark, sf_dir) -> inverted.Index:
    """The documents' index in the shared folder; made where their present files have none yet."""
    found = inverted.Index(spark, f"{tables.work_folder(spark)}/index/flat-positions-{tables.version(spark, sf_dir, 'documents')}", "doc_id", FIELDS)
    found.add(_titled(spark, sf_dir), segment="all")
    return found


# Words with their positions: fields are one apart.
_WORDS = rf"""d AS (SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), 1, 5), ' ') AS title, text FROM documents),
t AS (SELECT doc_id, {tok("title")} AS a, {tok("text")} AS b FROM d),
w AS (SELECT doc_id, 'A' AS class, unnest(a) AS term, generate_subscripts(a, 1) AS pos FROM t UNION ALL SELECT doc_id, 'C', unnest(b), len(a) + 1 + generate_subscripts(b, 1) FROM t)"""


@query(f"WITH {_WORDS}, c AS (SELECT term, doc_id, count(*) AS n FROM w WHERE starts_with(term, 'li') GROUP BY ALL) SELECT term, count(*) AS df, max(n)::INT AS most FROM c GROUP BY term")
def fts_dictionary(spark, sf_dir):
    """All terms of a prefix with their document frequencies; no postings are read."""
    return _index(spark, sf_dir).dictionary().where(F.col("term").startswith("li"))


@query(f"WITH {_WORDS}, h AS (SELECT a.doc_id, a.pos FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 AND b.term = 'license' JOIN w c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2 AND c.term = 'version' WHERE a.term = 'apache') SELECT doc_id, count(*)::INT AS hits, min(pos)::INT AS first FROM h GROUP BY doc_id")
def fts_phrase(spark, sf_dir):
    """Documents with three words one after another, from the index alone."""
    return _index(spark, sf_dir).phrase("Apache License, Version")


@query(f"WITH {_WORDS}, h AS (SELECT a.doc_id, a.pos FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 AND b.term = 'the' WHERE a.term = 'of') SELECT doc_id, count(*)::INT AS hits, min(pos)::INT AS first FROM h GROUP BY doc_id")
def fts_phrase_frequent(spark, sf_dir):
    """The same of two of the most frequent words."""
    return _index(spark, sf_dir).phrase("of the")


def _cover_sql(terms: list[str], classes: str = "CASE class WHEN 'A' THEN 1.0 ELSE 0.2 END") -> str:
    asked = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    last = ", ".join(f"max(CASE WHEN p = {i} THEN n END) OVER o AS l{i}" for i in range(len(terms)))
    every = " AND ".join(f"l{i} IS NOT NULL" for i in range(len(terms)))
    return f"""WITH {_WORDS}, q(p, t) AS (VALUES {asked}), m AS (SELECT doc_id, p, pos, ({classes})::DOUBLE AS wt FROM w JOIN q ON t = term),
    e AS (SELECT *, row_number() OVER o AS n, sum(1 / wt) OVER o AS s FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    l AS (SELECT *, {last} FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    b AS (SELECT *, CASE WHEN {every} THEN least({", ".join(f"l{i}" for i in range(len(terms)))}) END AS b FROM l),
    c AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM b),
    k AS (SELECT c.doc_id, (c.n - c.b + 1) / (c.s - e.s + 1 / e.wt) / (1 + greatest(c.pos - e.pos - (c.n - c.b), 0)) AS part FROM c JOIN e ON e.doc_id = c.doc_id AND e.n = c.b WHERE c.b > coalesce(c.before, 0))
    SELECT doc_id, round(sum(part), 6) AS score FROM k GROUP BY doc_id"""


@query(_cover_sql(["license", "version", "apache"]))
def fts_cover_density(spark, sf_dir):
    """Documents with all of three terms, by how close together they stand and in which fields."""
    return _index(spark, sf_dir).cover_density("license version Apache", CLASSES).withColumn("score", F.round("score", 6))


@query(_cover_sql(["ing", "er"]))
def fts_cover_density_pair(spark, sf_dir):
    """The same of two terms; stop words of the query are left out."""
    return _index(spark, sf_dir).cover_density("the ing er", CLASSES).withColumn("score", F.round("score", 6))


@query(f"WITH {_WORDS} SELECT doc_id, round(sum(CASE class WHEN 'A' THEN 1.0 ELSE 0.2 END), 6) AS score FROM w WHERE term IN ('apache', 'license') OR starts_with(term, 'ver') GROUP BY doc_id")
def fts_weight_classes(spark, sf_dir):
    """Documents with any of the terms, the last one a prefix, by the weights of the classes that match."""
    return _index(spark, sf_dir).cover_density("apache license ver", CLASSES, every=False, prefix_last=True).withColumn("score", F.round("score", 6))


@query(f"""WITH {_WORDS.partition("t AS")[0].rstrip().rstrip(",")}, b AS ({bm25_sql("d", "doc_id", {"title": 4.0, "text": 1.0}, T.query_terms("license reading"), True, 20, 9)}), p AS (SELECT doc_id, score, string_split_regex(text, '\\s+') AS ps FROM b JOIN documents USING (doc_id)),
h AS (SELECT *, list_min(list_transform(list_filter(list_zip(list_transform(ps, lambda x: len(list_intersect(list_transform(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+'), lambda y: lower(y)), ['license', 'reading'])) > 0), range(len(ps))), lambda z: z[1]), lambda z: z[2])) AS hit FROM p)
SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, score, CASE WHEN hit IS NOT NULL THEN array_to_string(list_slice(ps, greatest(hit - 5, 0) + 1, greatest(hit - 5, 0) + 40), ' ') END AS snippet FROM h""")
def fts_snippets(spark, sf_dir):
    """The 20 best documents with what surrounds the first match; texts are read for these only."""
    top = inverted.best_rows(_index(spark, sf_dir).bm25("license reading", {"title": 4.0}), "doc_id", 20)
    met = inverted.with_texts(top, tables.load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return met.select("doc_id", "rank", "score", search.snippet(F.col("text"), "license reading").alias("snippet"))


_CHANGED = f"""f AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' license renewed' ELSE text END AS text FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 <> 0),
b AS ({bm25_sql("f", "doc_id", {"text": 1.0}, T.query_terms("license renew"), True, None)}), s AS (SELECT count(*) AS n_rows, sum(len({tok("text")}))::BIGINT AS n_words FROM f)"""


@query(f"WITH {_CHANGED} SELECT state, doc_id, score, n_rows, n_words FROM b, s, (VALUES ('segments'), ('compacted'), ('rebuilt')) v(state)")
def fts_segments(spark, sf_dir):
    """Scores from an index after two additions, a change of each fifth document and a removal of each seventh other one; after
    compaction; and from one that is built anew: all the same."""
    d = tables.load(spark, sf_dir, "documents").select("doc_id", "text")
    home = f"{tables.work_folder(spark)}/index/segments-{uuid.uuid4().hex}"
    changed = d.where("doc_id % 5 = 0").withColumn("text", F.concat("text", F.lit(" license renewed")))
    kept = d.where("doc_id % 5 <> 0 and doc_id % 7 <> 0")
    found, anew = (inverted.Index(spark, f"{home}/{n}", "doc_id", ("text",)) for n in ("found", "anew"))
    found.add(d.where("doc_id % 3 <> 0"))
    found.add(d.where("doc_id % 3 = 0"))
    found.add(changed, changed)
    found.add(None, d.where("doc_id % 7 = 0 and doc_id % 5 <> 0"))
    anew.add(changed.unionByName(kept))

    def scores(of: inverted.Index, state: str) -> DataFrame:
        rows, words = of.totals()
        return tables.staged(of.bm25("license renew").select(F.lit(state).alias("state"), "doc_id", F.round("score", 6).alias("score"), F.lit(rows).alias("n_rows"), F.lit(words).alias("n_words")), "scores")

    out = scores(found, "segments")
    assert len(list(found.compact(2, 2))) == 2
    found.clean()
    out = out.unionByName(scores(found, "compacted")).unionByName(scores(anew, "rebuilt"))
    tables.remove(spark, home)
    return out
