import random

import pytest
from pyspark.sql import functions as F

from strata.operators import inverted, search
from strata.operators.inverted import Index

SCHEMA = "id long, title string, text string"


def rows(spark, found):
    return spark.createDataFrame(found, SCHEMA)


def scores(df):
    return {r["id"]: round(r["score"], 9) for r in df.collect()}


def state(index):
    """All that an index says, however it came about."""
    return (
        sorted(map(tuple, index.dictionary().select("term", "df").collect())), index.totals(), sorted((r["id"], r["length"], sorted(r["terms"])) for r in index.rows().collect()),
        sorted((r["term"], r["id"], r["length"], r["tf"], r["places"]) for r in index.postings(F.lit(True)).collect()),
    )


@pytest.fixture
def index(spark, tmp_path):
    return lambda name="a": Index(spark, str(tmp_path / name), "id", ("title", "text"))


def test_segments_equal_a_rebuild(spark, index):
    """Random additions, changes and removals: after each, and after compactions, the index is that of the rows there are."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["licence", "licensed", "der"]
    text = lambda n: " ".join(rng.choices(words, k=rng.randrange(n)))
    found, held = index(), {}
    for step in range(7):
        put = {i: (text(4), text(9)) for i in rng.sample(range(30), 8)}
        gone = rng.sample(range(30), 5) if step else []
        held = {i: v for i, v in held.items() if i not in gone} | put
        out = spark.createDataFrame([(i,) for i in {*gone, *put}], "id long") if step else None
        found.add(rows(spark, [(i, *v) for i, v in put.items()]), out)
        if step in (3, 6):
            assert list(found.compact(3, 2)) and len(found.segments()) == 3
            found.clean()
    anew = index("b")
    anew.add(rows(spark, [(i, *v) for i, v in held.items()]))
    assert state(found) == state(anew)
    docs = rows(spark, [(i, *v) for i, v in held.items()])
    for q in ("w1 w2", "w3 lic", "absent", "the", ""):
        assert scores(found.bm25(q, {"title": 3.0})) == scores(search.bm25(docs, q, "id", {"title": 3.0, "text": 1.0}))
    list(found.compact(1, 5))
    assert state(found) == state(anew) and len(found.segments()) == 1


def test_a_batch_given_again(spark, index):
    found = index()
    for _ in range(2):
        found.add(rows(spark, [(1, "a", "b c"), (2, None, "b")]), segment="b0")
        found.add(rows(spark, [(1, "a", "d")]), rows(spark, [(1, None, None), (None, None, None), (9, None, None)]), segment="b1")
    assert found.totals() == (2, 3) and len(found.segments()) == 2
    assert {r["term"]: r["df"] for r in found.dictionary().collect()} == {"a": 1, "b": 1, "d": 1}
    found.add(None, rows(spark, [(1, "", ""), (2, "", "")]))
    assert found.totals() == (0, 0) and found.bm25("a b").count() == 0 == found.dictionary().count()


def test_phrases(spark, index):
    found = index()
    texts = [(1, "New York", "new york city, New York"), (2, "york", "new"), (3, "x new", "york"), (4, None, "the the end the the the"), (5, "", None), (6, "new", "york new new york")]
    found.add(rows(spark, texts))
    got = lambda q: sorted(map(tuple, found.phrase(q).collect()))
    assert got("new york") == [(1, 3, 1), (6, 1, 5)]  # not over the end of a field
    assert got("the the") == [(4, 3, 2)] and got("the end") == [(4, 1, 3)]
    assert got("york new new york") == [(6, 1, 3)] and got("york") == [(1, 3, 2), (2, 1, 1), (3, 1, 4), (6, 2, 3)]
    assert got("") == got("absent new") == []
    terms, known = found.expansions("the ne", True)
    assert terms == ["ne"] and known == {"new": 4}


def brute_cover(entries, n):
    """Least stretches that hold all terms, by trying all; entries are (position, term, weight) in order."""
    total = 0.0
    for a in range(len(entries)):
        for b in range(a, len(entries)):
            held = {t for _, t, _ in entries[a : b + 1]}
            if len(held) == n and len({t for _, t, _ in entries[a + 1 : b + 1]}) < n and len({t for _, t, _ in entries[a:b]}) < n:
                part = entries[a : b + 1]
                noise = part[-1][0] - part[0][0] + 1 - len(part)
                total += len(part) / sum(1 / w for _, _, w in part) / (1 + noise)
    return total


def test_cover_density(spark, index):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choices("abcdx", k=rng.randrange(5))), " ".join(rng.choices("abcdxyz", k=rng.randrange(25)))) for i in range(40)]
    found = index()
    found.add(rows(spark, texts))
    classes = {"title": "A", "text": "D"}
    for asked in ("b", "b c", "b c d"):
        want = {}
        for i, title, text in texts:
            places = [(p + 1, t, 1.0) for p, t in enumerate(title.split())] + [(len(title.split()) + 2 + p, t, 0.1) for p, t in enumerate(text.split())]
            got = brute_cover([e for e in places if e[1] in asked.split()], len(asked.split()))
            if got:
                want[i] = round(got, 9)
        assert scores(found.cover_density(asked, classes)) == want
    any_of = scores(found.cover_density("b c", classes, every=False))
    assert any_of == {i: round(sum(w in "bc" for w in a.split()) + 0.1 * sum(w in "bc" for w in b.split()), 9) for i, a, b in texts if {"b", "c"} & {*a.split(), *b.split()}}


def test_plans_read_what_is_asked(spark, index, capsys):
    """Terms reach the scan of postings, and the dictionary is read without them."""
    found = index()
    found.add(rows(spark, [(1, "a", "b c")]))
    found.bm25("b", prefix_last=False).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,b)]" in plan or "In(term, [b])" in plan
    found.dictionary().explain("formatted")
    assert "postings" not in capsys.readouterr().out


def test_many_expansions(spark, index, monkeypatch):
    monkeypatch.setattr(inverted, "LISTED", 2)
    found = index()
    docs = rows(spark, [(i, None, f"pre{i} x") for i in range(6)])
    found.add(docs)
    assert found.expansions("pre")[1] is None
    assert scores(found.bm25("pre")) == scores(search.bm25(docs, "pre", "id", {"title": 1.0, "text": 1.0}))
