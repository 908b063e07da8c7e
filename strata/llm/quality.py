"""Quality rules: a ledger of failure bits and measurements, policies over it, and ablations of a policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, fresh, keep_where, stage, table, words

#: Words in a window of the repetition rule.
SPAN = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements. Its place in RULES is its bit and never changes."""

    name: str
    fails: str


#: Bit 0 first. Add new rules at the end, so that stored ledgers stay valid.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails any of the rules named. Policies are versioned and never edited."""

    version: str
    reject: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        places = {r.name: i for i, r in enumerate(rules)}
        return sum(1 << places[name] for name in self.reject)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICY = Policy("v1", tuple(r.name for r in RULES))


def _repeat_words(hashes: Column) -> Column:
    """Words in windows of SPAN words that occur at least twice in a text, from the hashes of its words.

    Each window is a 64-bit hash of its words; only texts that have a repeated window are looked at further:
    windows are sorted by hash, those equal to a neighbour are kept, and the words they cover are counted
    from place to place.
    """

    def windows(h: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(h) - (SPAN - 1)), lambda i: F.xxhash64(F.slice(h, i, SPAN)))
        return F.when(F.size(h) < SPAN + 1, 0).otherwise(F.transform(F.array(made), looked_at)[0])

    def covered(w: Column) -> Column:
        h = lambda j: F.get(w, j)["h"]
        same = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda j: (h(j) == h(j - 1)) | (h(j) == h(j + 1)))
        starts = F.sort_array(F.transform(same, lambda j: F.get(w, j)["i"]))
        first = F.struct(F.lit(-SPAN).alias("last"), F.lit(0).alias("sum"))
        step = lambda a, s: F.struct(s.alias("last"), (a["sum"] + F.least(F.lit(SPAN), s - a["last"])).alias("sum"))
        return F.aggregate(starts, first, step, lambda a: a["sum"])

    # Let-bindings by transform over one element: hashes, windows and sorted pairs are each made once.
    def looked_at(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(F.transform(F.array(pairs), covered)[0])

    return F.transform(F.array(hashes), windows)[0]


def measure(docs: DataFrame) -> DataFrame:
    """Add the measurements, each a long, to documents. A null or empty text has no words, lines or symbols.

    One pass, row by row, without a shuffle; all of a text is read, however long. Equal rows measure alike, no rows give
    none. An existing column of the same name is replaced, all others stay.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    ws, ls, hs = fresh(docs, "words", "lines", "hashes")
    rows = docs.drop(*MEASURES).withColumn(ws, words(F.col("text"))).withColumn(ls, lines)
    rows = rows.withColumn(hs, F.transform(ws, lambda w: F.xxhash64(w)))
    found = {
        "n_words": F.size(ws),
        "word_chars": F.length(F.array_join(ws, "")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
        "n_repeat_words": _repeat_words(F.col(hs)),
        "n_lines": F.size(ls),
    }
    return rows.select(*docs.drop(*MEASURES).columns, *[v.cast("long").alias(k) for k, v in found.items()])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``failed``, a long whose bit i tells that rule i fails; each rule is evaluated once.

    Null and empty texts fail what their zero measurements fail; equal rows fail alike, no rows give none; an existing
    column named failed is replaced, all others stay.
    """
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(docs).withColumn("failed", failed)


def apply_policy(rows: DataFrame, policy: Policy = POLICY, base: Policy = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add base_failed and kept to a ledger; no rule is evaluated again. What the base policy rejects is never kept.

    Equal rows are judged alike, no rows give none; existing columns of these names are replaced.
    """
    fails = lambda mask: F.col("failed").bitwiseAND(F.lit(mask)) != 0
    return rows.withColumn("base_failed", fails(base.mask(rules))).withColumn("kept", ~fails(base.mask(rules) | policy.mask(rules)))


def ablations(rows: DataFrame, policy: Policy = POLICY, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: rule, failed (documents that fail it), alone (that only it rejects), kept_without.

    Documents are first counted by their failure bits, at most 2 ** len(rules) rows, so nothing is read again. Repeated rows
    count each; of no rows nothing is said.
    """
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask(rules))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    named = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if r.name in policy.reject])
    each = counts.select("bits", "n", F.inline(named))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    bits, bit = F.col("bits"), F.col("bit")
    return each.groupBy("rule").agg(total(bits.bitwiseAND(bit) != 0).alias("failed"), total(bits == bit).alias("alone"), total((bits == 0) | (bits == bit)).alias("kept_without"))


def keep_good(docs: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """The documents that a policy keeps, with the columns given, whatever their names.

    Null and empty texts have no words and fail; texts of any length are read whole; repeated rows are judged alike, no rows give none.
    """
    kept = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return keep_where(apply_policy(ledger(kept), policy), "kept").select("row.*")


def write_ledger(docs: DataFrame) -> DataFrame:
    """The ledger of documents (doc_id, measurements, failed), written to the shared folder: policies and ablations read it, not the texts.

    A row for each document, null ids and repeats included; no rows make an empty one.
    """
    return stage(ledger(docs.select("doc_id", "text")).drop("text"), "ledger")


#: A second version, for comparison: without the rules on the lengths of words.
EARLIER = Policy("v0", ("few_words", "repeated_words", "symbols", "repeated_lines"))


def quality_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the policy over one stored ledger: for each rule how many documents fail it, fail it alone, and are kept without it;
    null, empty and repeated texts are documents like others, and no documents give no rows."""
    led = write_ledger(table(spark, sf_dir, "documents"))
    rows = None
    for policy in (EARLIER, POLICY):
        one = ablations(led, policy).withColumn("version", F.lit(policy.version))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdict of every document."""
    rows = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", *MEASURES[:5], "base_failed", "kept", "n_lines", "failed")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         row_number() OVER () AS k FROM documents),
p AS (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, list_slice(w, i, i + 7)) AS c FROM p),
c AS (SELECT k, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
      FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM g WHERE c > 1) GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
      FROM d LEFT JOIN c USING (k)),
f AS (SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
                + 8 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
                + 32 * (word_chars > 20 * n_words)::BIGINT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, n_lines, failed FROM f
"""

QUALITY_POLICIES_SQL = OP7_SQL.rsplit("SELECT", 1)[0] + ", " + "r(bit, rule) AS (VALUES " + ", ".join(f"({1 << i}, '{r.name}')" for i, r in enumerate(RULES)) + "), v(version, mask) AS (VALUES " + ", ".join(f"('{p.version}', {p.mask()})" for p in (EARLIER, POLICY)) + """)
SELECT rule, count(*) FILTER (failed & bit <> 0) AS failed, count(*) FILTER (failed & mask = bit) AS alone, count(*) FILTER (failed & mask IN (0, bit)) AS kept_without, version FROM f, r, v WHERE mask & bit <> 0 GROUP BY rule, bit, version"""
