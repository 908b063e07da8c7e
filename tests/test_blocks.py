"""Indexes hold blocks of postings, and words are found in Arrow batches: the same words, fewer rows. Each test failed before."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from strata.functions import text as T
from strata.operators import inverted, search, words
from strata.sources import tables

ODD = ["Ab_c1 ÉTÉ İx ΣΑΣ 中文, áb \U00010400z", "", None, "x", "X² ٣٤ _", "é", "-", "end\n", "\U0001f600ok\U0001f600", "tailé"]


def test_words_are_those_of_the_tokenizer(spark, monkeypatch):
    """Capitals, marks, other scripts, ends of rows and empty texts: as T.tokens() has them, however a batch is parted."""
    docs = spark.createDataFrame(list(enumerate(ODD)), "id long, t string").coalesce(1)
    want = {r["id"]: list(r["w"]) for r in docs.select("id", T.tokens(F.col("t")).alias("w")).collect()}
    for part in (words.PART, 1):
        monkeypatch.setattr(words, "PART", part)
        found = words.term_blocks(docs, "id", {"t": 1.0}, placed=True, listed=True)
        at = sorted((r["id"], p, r["term"]) for r in words.each_posting(found.where("term is not null"), "id").collect() for p in r["places"])
        got = {i: [t for j, _, t in at if j == i] for i in want}
        assert got == want
        own = found.where("term is null").collect()
        assert {r["id"]: (r["length"], sorted(r["terms"])) for r in own} == {i: (len(w), sorted(set(w))) for i, w in want.items()}


def test_an_index_is_written_in_blocks(spark):
    """A term of many rows is few rows of the index, none of more than BLOCK postings; what it holds is what each text has."""
    docs = spark.range(1200).select(F.col("id"), F.concat(F.lit("the same "), F.col("id").cast("string"), F.lit(" the")).alias("t")).coalesce(1)
    home = f"{tables.work_folder(spark)}/blocks-test"
    search.write_index(docs, f"{home}/a", "id", {"t": 2.0})
    held = spark.read.parquet(f"{home}/a/postings")
    sizes = [r[0] for r in held.where("term in ('the', 'same')").select(F.size("keys")).collect()]
    assert sum(sizes) == 2400 and len(sizes) == 2 * -(-1200 // words.BLOCK) and max(sizes) == words.BLOCK
    every = lambda rows: sorted(map(tuple, rows.select("id", "length", "term", "tf").collect()))
    assert every(search.stored_postings(spark, f"{home}/a", "id")) == every(search.postings(docs, "id", {"t": 2.0}))
    now = docs.where("id % 3 <> 0").withColumn("t", F.when(F.col("id") % 2 == 0, "new the").otherwise(F.col("t")))
    search.update_index(spark, f"{home}/a", f"{home}/b", "id", docs.where("id % 3 = 0 or id % 2 = 0"), now.where("id % 2 = 0"), {"t": 2.0})
    assert every(search.stored_postings(spark, f"{home}/b", "id")) == every(search.postings(now, "id", {"t": 2.0}))
    index = inverted.Index(spark, f"{home}/c", "id", ("t",))
    index.add(docs)
    index.add(now.where("id % 2 = 0"), docs.where("id % 3 = 0 or id % 2 = 0"))
    list(index.compact(1, 2))
    got = index.postings(F.lit(True)).withColumn("tf", 2.0 * F.col("tf"))
    assert every(got) == every(search.postings(now, "id", {"t": 2.0})) and len(index.segments()) == 1
    assert index._part("postings", index.segments()).count() < 1200


def test_terms_are_not_copied_for_each_other(spark, capsys):
    """A text's counts are not carried beside each of its terms, which grows with the square of its words."""
    search.postings(spark.createDataFrame([(1, "a b")], "id long, t string"), "id", {"t": 1.0}).explain()
    assert "posexplode" not in capsys.readouterr().out


def test_long_keys_are_not_spelled_out_in_blocks(spark, monkeypatch):
    """Blocks hold numbers in place of keys that are strings, places one after another; whatever is added, replaced and merged, the index is that of the rows."""
    docs = spark.range(600).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.concat(F.lit("the same "), (F.col("id") % 50).cast("string"), F.lit(" the")).alias("t"), "id").repartition(3, "id")
    home = f"{tables.work_folder(spark)}/numbered-test"
    every = lambda index: sorted(map(tuple, index.postings(F.lit(True)).collect()))
    scores = lambda index: {r["k"]: round(r["score"], 9) for r in index.bm25("the 7").collect()}
    monkeypatch.setattr(words, "PART", 70)
    index, anew = (inverted.Index(spark, f"{home}/{n}", "k", ("t",)) for n in "ab")
    index.add(docs)
    held = index._part("postings", index.segments())
    assert held.columns[:3] == ["term", "base", "keys"] and held.schema["places"].dataType.simpleString() == "array<int>"
    assert tables.size(spark, f"{home}/a/postings/segment=s1") < 600 * 64
    now = docs.where("id % 3 <> 0").withColumn("t", F.when(F.col("id") % 2 == 0, "new the").otherwise(F.col("t")))
    index.add(now.where("id % 2 = 0"), docs.where("id % 3 = 0 or id % 2 = 0"))
    index.add(None, docs.where("id = 1"))
    anew.add(now.where("id <> 1"))
    want = search.bm25(now.where("id <> 1"), "the 7", "k", {"t": 1.0})
    for most in (9, 2, 1):
        list(index.compact(most, 2))
        assert every(index) == every(anew) and index.totals() == anew.totals()
        assert scores(index) == {r["k"]: round(r["score"], 9) for r in want.collect()}
    with pytest.raises(OverflowError):
        words._first_number(1 << words.SEGMENT_BITS, 0, 0, 1)
