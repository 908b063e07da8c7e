"""License scans: an index of the rarest words of license texts by position, votes for alignments, key phrases.

A looked-up word votes for the offset of its template in the text. Published licenses have numbers before clauses and names of
holders in them, so votes of one template count together within a band of offsets, each place of the template once, and key
phrases must follow each other in order near their places. Base phrases stand at one offset exactly.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_texts as L
from .common import fresh, table

#: Between words, after A-Z are lower-cased: ASCII but for digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Index words of a template: its rarest in the documents.
RARE = 8
#: Share of a template's index weight that an alignment needs.
SHARE = 0.5
#: Words by which offsets of one alignment may differ: what numbers and names put in between.
BAND = 24
#: Words that stand for names in templates; they are no index words.
SLOTS = ("author", "authors", "copyright", "holder", "holders", "library", "program")
#: Weights are whole numbers, so that sums do not depend on their order.
UNIT = 1_000_000_000


@dataclass(frozen=True)
class Template:
    """A license's text in words, and the phrases of it that must all be at their places."""

    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split(" ")

    @property
    def places(self) -> list[int]:
        """Where each phrase begins in the text; of several places the first."""
        w = self.words
        return [next(i for i in range(len(w)) if w[i : i + len(p)] == p) for p in (x.split(" ") for x in self.phrases)]


def _base(label: str, phrase: str) -> Template:
    return Template(label, phrase, (phrase,), True)


def _whole(label: str, text: str, *phrases: str) -> Template:
    """A template of a license's text as it is written."""
    return Template(label, " ".join(re.findall("[a-z0-9]+", text.lower())), phrases)


# The phrases that always count; then texts of licenses with what tells each from the others, versions and clauses included.
TEMPLATES = (
    _base("gpl", "gnu general public license"),
    _base("apache", "apache license"),
    _base("cc-by", "cc by"),
    _base("mit", "mit license"),
    _whole("gpl-2.0", L.GPL_2, "the gnu general public license as published", "either version 2 of the license or at your option any later version"),
    _whole("gpl-3.0", L.GPL_3, "the gnu general public license as published", "either version 3 of the license or at your option any later version"),
    _whole("lgpl-2.1", L.LGPL_21, "the gnu lesser general public license as published", "either version 2 1 of the license"),
    _whole("lgpl-3.0", L.LGPL_3, "the gnu lesser general public license as published", "either version 3 of the license"),
    _whole("agpl-3.0", L.AGPL_3, "the gnu affero general public license as published", "either version 3 of the license"),
    _whole("apache-2.0", L.APACHE_2, "you may not use this file except in compliance with the license", "apache org licenses license 2 0"),
    _whole("mit", L.MIT, "permission is hereby granted free of charge to any person obtaining a copy", "to deal in the software without restriction"),
    _whole("bsd-2-clause", L.BSD_2, "redistributions in binary form must reproduce", "provided with the distribution this software is provided"),
    _whole("bsd-3-clause", L.BSD_3, "redistributions in binary form must reproduce", "may be used to endorse or promote products"),
    _whole("isc", L.ISC, "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    _whole("zlib", L.ZLIB, "the origin of this software must not be misrepresented"),
    _whole("bsl-1.0", L.BOOST, "to use reproduce display distribute execute and transmit the software"),
    _whole("mpl-2.0", L.MPL_2, "subject to the terms of the mozilla public license v 2 0"),
    _whole("unlicense", L.UNLICENSE, "this is free and unencumbered software released into the public domain"),
    _whole("cc0-1.0", L.CC0, "has dedicated the work to the public domain"),
    _whole("cc-by-4.0", L.CC_BY, "creative commons attribution 4 0 international license"),
    _whole("cc-by-sa-4.0", L.CC_BY_SA, "creative commons attribution sharealike 4 0 international license"),
    _whole("cc-by-nc-4.0", L.CC_BY_NC, "creative commons attribution noncommercial 4 0 international license"),
)

VOCABULARY = tuple(sorted({w for t in TEMPLATES for w in t.words}))


def license_words(text: Column) -> Column:
    """The words of a text for license scans; a null text has none. A-Z alone are lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, BREAK, -1), lambda w: w != "")


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Documents, and for each word of VOCABULARY how many have it; over all documents, at most a row for each word."""
    found = F.array_distinct(F.filter(license_words(F.col("text")), lambda w: w.isin(*VOCABULARY)))
    counts = docs.select(F.explode(F.array_append(found, F.lit(""))).alias("w")).groupBy("w").count().collect()
    df = {r[0]: r[1] for r in counts}
    return df.pop("", 0), df


def build_index(n_docs: int, df: dict[str, int], templates: tuple[Template, ...] = TEMPLATES, rare: int = RARE) -> dict[str, list[tuple[int, int, int]]]:
    """Postings of the words to look up: word to (template, position, share of the template's index weight).

    Each template is indexed by its ``rare`` words of highest IDF in the documents but SLOTS, a base phrase by one. Shares are in
    parts of UNIT.
    """
    idf = lambda w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1e-9
    postings: dict[str, list[tuple[int, int, int]]] = {}
    for t, template in enumerate(templates):
        known = set(template.words) if template.base else set(template.words) - set(SLOTS)
        chosen = sorted(known, key=lambda w: (-idf(w), w))[: 1 if template.base else rare]
        places = [(w, p) for p, w in enumerate(template.words) if w in chosen]
        total = sum(idf(w) for w, _ in places)
        for w, p in places:
            postings.setdefault(w, []).append((t, p, math.floor(UNIT * (idf(w) / total) + 0.5)))
    return postings


_VOTE = "struct<t:int,o:int,p:int,s:bigint>"
_FOUND = "array<struct<t:int,o:int,last:int,s:bigint>>"


def _alignments(w: Column, postings: dict[str, list[tuple[int, int, int]]], templates: tuple[Template, ...], share: float, band: int = BAND) -> Column:
    """(template, first and last offset, weight) of all alignments of enough weight whose phrases are near their places, in order.

    Votes are taken in order of template and offset. Those of the last ``band`` words of offsets are held, and weigh together
    each place of the template once; offsets at which they weigh enough, no further apart than the band, are one alignment.
    """
    by_word = F.create_map(*[x for word, ps in sorted(postings.items()) for x in (F.lit(word), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(s).cast("bigint").alias("s")) for t, p, s in ps]))])
    bands = F.array(*[F.lit(0 if t.base else band) for t in templates])
    hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda h: h["w"].isin(*sorted(postings)))
    votes = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(by_word, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("o"), p["p"].alias("p"), p["s"].alias("s")))))
    least = math.ceil(share * UNIT)
    made = lambda t, o, last, s: F.struct(t.cast("int").alias("t"), o.cast("int").alias("o"), last.cast("int").alias("last"), s.cast("bigint").alias("s"))

    def weighed(a, v):
        """The state after a vote that is already among the held ones: it ends, extends or begins an alignment, or none."""
        weight = F.aggregate(F.array_distinct(F.transform(a["held"], lambda x: F.struct(x["p"], x["s"]))), F.lit(0).cast("bigint"), lambda n, x: n + x["s"])
        open_ = F.try_element_at(a["out"], F.lit(-1))
        extends = (open_["t"] == v["t"]) & (open_["last"] >= v["o"] - F.get(bands, v["t"]))
        longer = F.array_append(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), made(v["t"], open_["o"], v["o"], F.greatest(open_["s"], weight)))
        new = F.array_append(a["out"], made(v["t"], F.get(a["held"], F.lit(0))["o"], v["o"], weight))
        return F.struct(a["held"].alias("held"), F.when(weight < least, a["out"]).when(extends, longer).otherwise(new).alias("out"))

    def step(a, v):
        held = F.array_append(F.filter(a["held"], lambda x: (x["t"] == v["t"]) & (x["o"] >= v["o"] - F.get(bands, v["t"]))), v)
        # the held votes are made once, as the one element of an array
        return F.transform(F.array(F.struct(held.alias("held"), a["out"].alias("out"))), lambda b: weighed(b, v))[0]

    start = F.struct(F.array().cast(f"array<{_VOTE}>").alias("held"), F.array().cast(_FOUND).alias("out"))
    found = F.aggregate(F.sort_array(votes), start, step, lambda a: a["out"])
    phrases = F.array(*[F.array(*[F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, p.split(" "))).alias("words")) for at, p in zip(t.places, t.phrases, strict=True)]) for t in templates])

    def there(a):
        wide = F.get(bands, a["t"])

        def after(x, p):
            """The first place of a phrase behind the one before; null where there is none."""
            first, last = F.greatest(a["o"] + p["at"] - wide, x + 1), a["last"] + p["at"] + wide
            near = F.when(x.isNotNull() & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.array_min(F.filter(near, lambda i: F.slice(w, i + 1, F.size(p["words"])) == p["words"]))

        return F.aggregate(F.get(phrases, a["t"]), F.lit(-1), after, lambda x: x.isNotNull())

    return F.filter(found, there)


def find_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, rare: int = RARE, share: float = SHARE) -> DataFrame:
    """Add ``licenses``: an array of (label, start, score, base) and n_words, over each whole text; start is the least offset.

    ``docs`` is read twice: word frequencies first, then the scan, row by row without a shuffle. A text without
    license words, empty or null gives an empty array; texts of any length are read whole; equal rows give equal
    arrays, no rows none. Existing columns of these names are replaced, all others stay, whatever their names.
    """
    docs = docs.drop("licenses", "n_words")
    (ws,) = fresh(docs, "words")
    postings = build_index(*document_frequencies(docs), templates, rare)
    labels = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base")) for t in templates])
    rows = docs.withColumn(ws, license_words(F.col("text"))).withColumn("n_words", F.size(ws).cast("long"))
    named = lambda a: F.struct(F.get(labels, a["t"])["label"].alias("label"), a["o"].alias("start"), F.least(a["s"] / UNIT, F.lit(1.0)).alias("score"), F.get(labels, a["t"])["base"].alias("base"))
    return rows.withColumn("licenses", F.transform(_alignments(F.col(ws), postings, templates, share), named)).drop(ws)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels and places of base phrases of every document."""
    rows = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "licenses")
    base = F.filter("licenses", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    listed = lambda xs: F.array_join(F.sort_array(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    scores = F.coalesce(F.round(F.array_max(F.transform("licenses", lambda x: x["score"])), 6), F.lit(0.0))
    return rows.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), listed(base).alias("base_labels"), listed(F.col("licenses")).alias("labels"), scores.alias("score"))


def _oracle_sql() -> str:
    """The same in SQL: frequencies, the rarest words, votes by offset, phrases at their places."""
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, {listed(t.words)})" for i, t in enumerate(TEMPLATES))
    assert max(len(t.phrases) for t in TEMPLATES) <= 2  # which is what the text below can follow
    phrases = ", ".join(f"({i}, {no}, {listed(p.split(' '))}, {at})" for i, t in enumerate(TEMPLATES) for no, (at, p) in enumerate(zip(t.places, t.phrases, strict=True)))
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    t(t, label, base, words) AS (VALUES {rows}),
    ph(t, no, phrase, pos) AS (VALUES {phrases}),
    tw AS (SELECT DISTINCT t, base, unnest(words) AS x FROM t),
    n AS (SELECT count(*)::DOUBLE AS n FROM d),
    df AS (SELECT x, count(*)::DOUBLE AS df FROM (SELECT DISTINCT k, unnest(w) AS x FROM d) WHERE x IN (SELECT x FROM tw) GROUP BY x),
    i AS (SELECT t, base, x, ln((n + 1) / (coalesce(df, 0) + 1)) + 1e-9 AS idf FROM tw LEFT JOIN df USING (x), n WHERE base OR x NOT IN ({", ".join(f"'{w}'" for w in SLOTS)})),
    c AS (SELECT t, x, idf FROM i QUALIFY row_number() OVER (PARTITION BY t ORDER BY idf DESC, x) <= CASE WHEN base THEN 1 ELSE {RARE} END),
    u AS (SELECT t, unnest(words) AS x, generate_subscripts(words, 1) - 1 AS p FROM t),
    s AS (SELECT t, x, p, floor({UNIT} * (idf / sum(idf) OVER (PARTITION BY t)) + 0.5)::BIGINT AS s FROM u JOIN c USING (t, x)),
    h AS (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d),
    v AS (SELECT k, t, base, CASE WHEN base THEN 0 ELSE {BAND} END AS band, i - p AS o, p, s FROM h JOIN s USING (x) JOIN t USING (t)),
    y AS (SELECT k, t, base, band, o, min(b) AS low, sum(s)::BIGINT AS s FROM (SELECT v.k, v.t, v.base, v.band, v.o, x.p, x.s, min(x.o) AS b FROM (SELECT DISTINCT k, t, base, band, o FROM v) v JOIN v x ON x.k = v.k AND x.t = v.t AND x.o BETWEEN v.o - v.band AND v.o GROUP BY ALL)
          GROUP BY ALL HAVING sum(s) >= {math.ceil(SHARE * UNIT)}),
    z AS (SELECT *, sum(fresh) OVER (PARTITION BY k, t ORDER BY o) AS no FROM (SELECT *, CASE WHEN o - lag(o) OVER (PARTITION BY k, t ORDER BY o) <= band THEN 0 ELSE 1 END AS fresh FROM y)),
    al AS (SELECT k, t, base, band, no, min(low) AS o, max(o) AS last, max(s) AS s FROM z GROUP BY ALL),
    a1 AS (SELECT al.*, min(j) AS x1 FROM al JOIN d USING (k) JOIN ph ON ph.t = al.t AND ph.no = 0, unnest(range(greatest(o + pos - band, 0), last + pos + band + 1)) r(j) WHERE list_slice(d.w, j + 1, j + len(phrase)) = phrase GROUP BY ALL),
    a2 AS (SELECT a1.k, a1.t, a1.no, min(j) AS x2 FROM a1 JOIN d USING (k) JOIN ph ON ph.t = a1.t AND ph.no = 1, unnest(range(greatest(o + pos - band, x1 + 1), last + pos + band + 1)) r(j) WHERE list_slice(d.w, j + 1, j + len(phrase)) = phrase GROUP BY ALL),
    f AS (SELECT a1.k, o, least(s / {UNIT}.0, 1.0) AS s, label, t.base FROM a1 JOIN t USING (t) LEFT JOIN a2 USING (k, t, no) WHERE x2 IS NOT NULL OR NOT EXISTS (SELECT 1 FROM ph WHERE ph.t = a1.t AND ph.no = 1))
    SELECT doc_id, len(w)::BIGINT AS n_words, count(o) FILTER (base) AS n_base, min(o) FILTER (base) AS first_word, max(o) FILTER (base) AS last_word,
           coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
           coalesce(round(max(s), 6), 0.0)::DOUBLE AS score
    FROM d LEFT JOIN f USING (k) GROUP BY k, doc_id, w"""


OP6_SQL = _oracle_sql()
