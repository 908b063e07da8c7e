"""A positional full-text index in immutable segments, with a dictionary of terms.

Each change of the indexed rows writes one segment and nothing else: postings in order of terms, a row for each block of a
term's (term, keys, lengths, ends, places, most), a dictionary (term, df, most), the rows' own terms (key, length, terms), the keys that it removes from older segments,
and, last, one row of statistics, with which it takes effect. Where keys are strings, rows have numbers, which blocks hold in
place of keys: a key is spelled out once, not for each of its row's terms, and found postings meet the rows for it. A place is a word's position over all fields times FIELDS plus
its field's number, so weights of fields or classes are chosen by the query. Fields are one position apart.

A row of a segment lives until a later segment removes its key. Dictionaries and statistics add up: a segment that removes
rows counts their terms down. So document frequencies and prefixes come from the dictionary alone, whatever was removed.
compact() merges runs of neighbouring segments, the smallest first, and drops what they removed. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources import tables
from .search import _phrases, _scored
from .words import FIELDS, blocks_of, each_posting, term_blocks

#: Expansions of a prefix that are listed in a filter; with more, postings are filtered by the prefix itself.
LISTED = 1000
#: Live segments from which on compact() merges, and how many at a time.
SEGMENTS, RUN = 8, 4
#: Weights of the classes A to D in cover density.
CLASSES = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
_GROUP_BYTES = 8 << 20
_ROW = ("row", "length", "terms")

_STATS = "segment string, seq long, docs long, words long, dead_docs long, dead_words long, removed long, replaces array<string>"


@dataclass(frozen=True)
class Index:
    """An index below ``path`` over the rows of ``key`` and the texts of ``fields``, in order."""

    spark: SparkSession
    path: str
    key: str
    fields: tuple[str, ...]

    # reading ---------------------------------------------------------------------------------------------------------

    def segments(self) -> list[Row]:
        """The statistics of the segments that count, oldest first: complete, and replaced by no other."""
        if not tables.exists(self.spark, f"{self.path}/stats"):
            return []
        rows = self.spark.read.schema(_STATS).parquet(f"{self.path}/stats").collect()  # a row a segment
        gone = {s for r in rows for s in r["replaces"]}
        return sorted((r for r in rows if r["segment"] not in gone), key=lambda r: r["seq"])

    def totals(self, live: list[Row] | None = None) -> tuple[int, int]:
        """(rows, words) now. Here and below, ``live`` is what segments() gives, for callers that have it."""
        live = self.segments() if live is None else live
        return sum(r["docs"] - r["dead_docs"] for r in live), sum(r["words"] - r["dead_words"] for r in live)

    def _part(self, part: str, of: list[Row]) -> DataFrame | None:
        """A part of some segments, with their seq."""
        if not of:
            return None
        found = self.spark.read.option("basePath", f"{self.path}/{part}").parquet(*[f"{self.path}/{part}/segment={r['segment']}" for r in of])
        seqs = F.create_map(*[F.lit(x) for r in of for x in (r["segment"], r["seq"])])
        return found.withColumn("seq", F.element_at(seqs, F.col("segment").cast("string"))).drop("segment")

    def _live(self, rows: DataFrame, of: list[Row]) -> DataFrame:
        """Rows (key, seq) that none of these segments has removed."""
        removers = [r for r in of if r["removed"]]
        if not removers:
            return rows
        gone = self._part("removed", removers).groupBy(self.key).agg(F.max("seq").alias("_gone"))
        return rows.join(gone, self.key, "left").where(F.col("_gone").isNull() | (F.col("_gone") <= F.col("seq"))).drop("_gone")

    def dictionary(self, live: list[Row] | None = None) -> DataFrame:
        """(term, df, most) of all terms now: in how many rows it is, and at most how often in one."""
        found = self._part("dictionary", self.segments() if live is None else live)
        if found is None:
            return self.spark.createDataFrame([], "term string, df long, most int")
        return found.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most")).where("df > 0")

    def rows(self) -> DataFrame | None:
        """(key, length, terms) of all rows now."""
        live = self.segments()
        found = self._part("rows", live)
        return None if found is None else self._live(found, live).select(self.key, "length", "terms")

    def postings(self, condition: Column, live: list[Row] | None = None) -> DataFrame | None:
        """(term, key, length, tf, places) of the terms that a condition on ``term`` selects; it reaches the scan."""
        live = self.segments() if live is None else live
        found = self._part("postings", live)
        if found is None:
            return None
        each = self._living(each_posting(found.where(condition), self.key), live)
        return each.select("term", self.key, "length", F.size("places").alias("tf"), "places")

    def _living(self, postings: DataFrame, of: list[Row]) -> DataFrame:
        """Postings that none of these segments has removed; those with numbers get their keys and lengths from the rows."""
        if "row" not in postings.columns:
            return self._live(postings, of)
        return postings.join(self._live(self._part("rows", of), of).select("row", self.key, "length"), "row")

    # writing ---------------------------------------------------------------------------------------------------------

    def _write(self, part: str, segment: str, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/{part}/segment={segment}"
        rows.write.option("parquet.block.size", _GROUP_BYTES).option("compression", "zstd").mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _ordered(self, postings: DataFrame, held: int) -> DataFrame:
        """Blocks of postings, ``held`` bytes of Parquet, in order of terms; ranges over term and key put a frequent term into several files."""
        first = [*(["base"] if "base" in postings.columns else []), F.col("keys")[0]]
        return postings.repartitionByRange(*tables.parts(self.spark, held), "term", *first).sortWithinPartitions("term", *first)

    def _finish(self, segment: str, row: tuple) -> None:
        kept = Y.StructType(self.spark.createDataFrame([], _STATS).schema.fields[1:])
        self.spark.createDataFrame([row], kept).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/segment={segment}")

    def add(self, added: DataFrame | None, removed: DataFrame | None = None, segment: str | None = None) -> str:
        """Write a segment: rows of ``added`` (each key once) come in, the keys of ``removed`` go out of older segments; returns its name.

        A key in both is replaced. A segment of this name that is complete is left as it is, so that a batch that is
        given again changes nothing; an incomplete one is written anew.
        """
        live = self.segments()
        seq = max((r["seq"] for r in live), default=0) + 1
        segment = segment or f"s{seq}"
        if tables.exists(self.spark, f"{self.path}/stats/segment={segment}/_SUCCESS"):
            return segment
        kind = (added if added is not None else removed).select(self.key).schema[0].dataType.simpleString()
        if added is None:
            added = self.spark.createDataFrame([], ", ".join([f"`{self.key}` {kind}", *[f"`{f}` string" for f in self.fields]]))
        made = tables.staged(term_blocks(added, self.key, dict.fromkeys(self.fields, 1.0), placed=True, listed=True, segment=seq if kind == "string" else None), "words", "zstd")
        own = [self.key, *[c for c in _ROW if c in made.columns]]
        rows = self._write("rows", segment, made.where("term is null").select(*own))
        blocks = made.where("term is not null").drop(*own)
        postings = self._write("postings", segment, self._ordered(blocks, tables.size(self.spark, made.staged_at)))
        tables.drop(made)
        counted = postings.groupBy("term").agg(F.sum(F.size("keys")).alias("df"), F.max("most").alias("most"))
        dead, n_removed, dead_docs, dead_words = None, 0, 0, 0
        out = removed.select(self.key).where(F.col(self.key).isNotNull()).distinct() if removed is not None and live else None
        if out is not None:
            out = self._write("removed", segment, out)
            n_removed = out.count()
        if n_removed:
            dead = self._live(self._part("rows", live), live).join(out, self.key, "left_semi")
            dead_docs, dead_words = dead.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
            less = dead.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"), F.lit(0).alias("most"))
            counted = counted.unionByName(less).groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))
        self._write("dictionary", segment, counted.repartitionByRange("term").sortWithinPartitions("term"))
        docs, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        self._finish(segment, (seq, docs, words, dead_docs, dead_words, n_removed, []))
        return segment

    def merge(self, run: list[Row]) -> str:
        """Put neighbouring segments into one: rows that the run itself has removed are gone, what it removes from older ones stays."""
        oldest = run[0]["seq"] == self.segments()[0]["seq"]
        seq = run[-1]["seq"]
        segment = f"m{run[0]['seq']}-{seq}-{len(run)}"
        one = lambda part: self._live(self._part(part, run), run).drop("seq")
        self._write("rows", segment, one("rows"))
        held = sum(tables.size(self.spark, f"{self.path}/postings/segment={r['segment']}") for r in run)
        removers, n_removed, kept = [r for r in run if r["removed"]], 0, self._part("postings", run)
        if removers:
            kept = tables.staged(blocks_of(self._living(each_posting(kept, self.key), run), self.key), "kept", "zstd")
        self._write("postings", segment, self._ordered(kept.drop("seq"), held))
        if removers:
            tables.drop(kept)
        counted = self._part("dictionary", run).groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most")).where("df <> 0")
        self._write("dictionary", segment, counted.repartitionByRange("term").sortWithinPartitions("term"))
        if removers and not oldest:
            n_removed = self._write("removed", segment, self._part("removed", removers).select(self.key).distinct()).count()
        sums = [sum(r[c] for r in run) for c in ("docs", "words", "dead_docs", "dead_words")]
        self._finish(segment, (seq, *sums, n_removed, [r["segment"] for r in run] + [s for r in run for s in r["replaces"]]))
        return segment

    def compact(self, most: int = SEGMENTS, width: int = RUN) -> Iterator[str]:
        """Merge until at most ``most`` segments are live: each time the ``width`` neighbours of fewest words. Gives the new names.

        Segments grow by merging, so a row is copied about as often as the logarithm of their number says.
        """
        while len(live := self.segments()) > max(most, 1):
            n = min(width, len(live))
            start = min(range(len(live) - n + 1), key=lambda i: sum(r["words"] for r in live[i : i + n]))
            yield self.merge(live[start : start + n])

    def clean(self) -> None:
        """Delete the files of replaced segments; for when no reader of theirs is left."""
        live = {r["segment"] for r in self.segments()}
        for part in ("stats", "rows", "postings", "dictionary", "removed"):
            for name, is_folder, *_ in tables.listing(self.spark, f"{self.path}/{part}"):
                if is_folder and name.startswith("segment=") and name[8:] not in live and (part != "stats" or name[8:] in self._replaced()):
                    tables.remove(self.spark, f"{self.path}/{part}/{name}")

    def _replaced(self) -> set[str]:
        rows = self.spark.read.schema(_STATS).parquet(f"{self.path}/stats").select("replaces").collect()
        return {s for r in rows for s in r["replaces"]}

    # searching -------------------------------------------------------------------------------------------------------

    def expansions(self, query: str, prefix_last: bool = True, live: list[Row] | None = None) -> tuple[list[str], dict[str, int] | None]:
        """(the query's terms, document frequency of each term of the index that one of them stands for); None for too many.

        Only the dictionary is read.
        """
        terms = T.query_terms(query)
        if not terms:
            return [], {}
        found = self.dictionary(live).where(_asked(terms, prefix_last)).select("term", "df").limit(LISTED + 1).collect()
        return terms, {r["term"]: r["df"] for r in found} if len(found) <= LISTED else None

    def _found(self, query: str, prefix_last: bool, live: list[Row]) -> tuple[list[str], dict[str, int] | None, DataFrame | None]:
        """(terms, expansions, their live postings with ``phrase``, the place of the query's term that each stands for)."""
        terms, known = self.expansions(query, prefix_last, live)
        if not terms or known == {}:
            return terms, known, None
        asked = F.col("term").isin(*sorted(known)) if known is not None else _asked(terms, prefix_last)
        found = self.postings(asked, live)
        return terms, known, None if found is None else found.withColumn("phrase", F.explode(_phrases(F.col("term"), terms, prefix_last)))

    def _none(self, columns: str) -> DataFrame:
        rows = self.rows()
        kind = rows.schema[self.key].dataType.simpleString() if rows is not None else "string"
        return self.spark.createDataFrame([], f"`{self.key}` {kind}, {columns}")

    def bm25(self, query: str, weights: dict[str, float] | None = None, prefix_last: bool = True) -> DataFrame:
        """(key, score) as search.bm25() gives with these weights of fields, 1 by default."""
        live = self.segments()
        _, _, found = self._found(query, prefix_last, live)
        if found is None:
            return self._none("score double")
        n_docs, words = self.totals(live)
        chosen = [(weights or {}).get(f, 1.0) for f in self.fields]
        tf = F.col("tf").cast("double") if set(chosen) == {1.0} else F.aggregate("places", F.lit(0.0), lambda a, p: a + _by_field(p, chosen))
        counted = found.withColumn("tf", tf).groupBy(self.key, "length", "phrase").agg(F.sum("tf").alias("tf"))
        stats = self.spark.createDataFrame([(n_docs, words / n_docs if n_docs else None)], "n_docs long, mean_length double")
        return _scored(counted, stats, self.key)

    def phrase(self, words: str) -> DataFrame:
        """(key, hits, first) of rows that have these words one after another in a field: how often, and the first one's position.

        The rows of the rarest word are found first; other words' postings are kept of those rows only.
        """
        asked = [w.lower() for w in _words(words)]
        live = self.segments()
        known = {r["term"]: r["df"] for r in self.dictionary(live).where(F.col("term").isin(*asked)).collect()} if asked else {}
        if not asked or set(asked) - set(known):
            return self._none("hits int, first int")
        rarest = min(known, key=lambda t: (known[t], t))
        rare = self.postings(F.col("term") == rarest, live).select(self.key, "term", "places")
        rest = self.postings(F.col("term").isin(*[t for t in known if t != rarest]), live) if len(known) > 1 else None
        rows = rare if rest is None else rare.unionByName(rest.select(self.key, "term", "places").join(rare.select(self.key), self.key, "left_semi"))
        lists = rows.groupBy(self.key).agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))  # an entry a word asked for
        begin = lambda i, w: F.transform(F.element_at("at", F.lit(w)), lambda p: F.shiftright(p, 4) - i)
        begins = begin(0, asked[0])
        for i, w in enumerate(asked[1:], 1):
            begins = F.array_intersect(begins, begin(i, w))
        met = lists.where(F.size("at") == len(known)).select(self.key, begins.alias("b")).where(F.size("b") > 0)
        return met.select(self.key, F.size("b").alias("hits"), F.array_min("b").alias("first"))

    def cover_density(self, query: str, classes: dict[str, str], every: bool = True, prefix_last: bool = False) -> DataFrame:
        """(key, score) by cover density, with the fields' classes A to D.

        With ``every``, rows with all terms: each least stretch that holds all of them adds the harmonic mean of its matches'
        weights, over one more than the words in it that match nothing. Without, each match alone is such a stretch.
        """
        terms, _, found = self._found(query, prefix_last, self.segments())
        if found is None:
            return self._none("score double")
        weight = _by_field(F.col("place"), [CLASSES[classes[f]] for f in self.fields])
        each = found.select(self.key, "phrase", F.explode("places").alias("place")).withColumn("weight", weight)
        if not every:
            # a word that stands for several terms matches once
            return each.groupBy(self.key, "place").agg(F.max("weight").alias("weight")).groupBy(self.key).agg(F.sum("weight").alias("score"))
        order = Window.partitionBy(self.key).orderBy("place", "phrase")
        so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        each = each.withColumn("n", F.row_number().over(order)).withColumn("sum", F.sum(1 / F.col("weight")).over(so_far)).withColumn("pos", F.shiftright("place", 4))
        last = [F.max(F.when(F.col("phrase") == i, F.struct("n", "pos", (F.col("sum") - 1 / F.col("weight")).alias("before")))).over(so_far) for i in range(len(terms))]
        begin = last[0] if len(last) == 1 else F.least(*last)
        each = each.withColumn("_last", F.array(*last)).withColumn("begin", F.when(F.forall("_last", lambda x: x.isNotNull()), begin)).drop("_last")
        new = each.withColumn("_prior", F.lag("begin.n").over(order)).where(F.col("begin").isNotNull() & (F.col("begin.n") > F.coalesce("_prior", F.lit(0))))
        held = F.col("n") - F.col("begin.n") + 1
        noise = F.greatest(F.col("pos") - F.col("begin.pos") - held + 1, F.lit(0))
        part = held / (F.col("sum") - F.col("begin.before")) / (1 + noise)
        return new.groupBy(self.key).agg(F.sum(part).alias("score"))


def _asked(terms: list[str], prefix_last: bool) -> Column:
    exact = terms[:-1] if prefix_last else terms
    hit = F.col("term").isin(*exact) if exact else F.lit(False)
    return hit | F.col("term").startswith(terms[-1]) if prefix_last else hit


def _by_field(place: Column, values: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), place.bitwiseAND(FIELDS - 1) + 1)


def _words(text: str) -> list[str]:
    import re

    return re.findall(r"\w+", text or "")


def best_rows(scores: DataFrame, key: str, most: int = 20) -> DataFrame:
    """The rows of highest score, rounded to nine digits, with rank; ties by key."""
    from .search import ranked

    return ranked(scores.withColumn("score", F.round("score", 9)), [F.desc("score"), key], most)


def with_texts(top: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The rows of a top-k with their texts: the few keys go to the texts, not the texts to the keys."""
    return docs.join(F.broadcast(top), key)  # ``top`` is limited
