"""Main text of pages, importance resampling and ranked search, against brute force on small fixtures."""

import hashlib
import html
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strata.llm import importance, pages, wavelet

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
QUERIES = ["the quick fox", "the the the lazy DOG", None, "", "!!", "w1 w2 w3 w96 word", "é" * 5000, "mail me at example com license Software permission", "nowhere to be found x"]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)) + [(0, QUERIES[0]), (None, "word")], "item_id long, text string")


@pytest.fixture(scope="module")
def folder(spark, sf_dir, items):
    items.write.mode("overwrite").parquet(f"{sf_dir}/benchmark.parquet")
    return sf_dir


def documents(spark, folder):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


# main text ---------------------------------------------------------------------------------------------------------------


def text_of(page):
    return pages.main_text(page, {}, frozenset())


def test_given_pages(spark):
    def brute(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))) for p in re.split(r"</?(?:p|h1)>", inner)]
        return "\n".join(filter(None, (" ".join(p.split()) for p in parts)))

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r["page_id"]: r for r in pages.op11_pages(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == brute(r["html"]) and got[r["page_id"]]["n_chars"] == len(brute(r["html"]))


def test_markup():
    assert text_of("<article><h1>A&amp;B</h1><p>one<br>two <b>bo</b>ld<p>a < b &lt; c &amp &copy 3<li>x<li>y</article>after") == "A&B\none two bold\na < b < c & © 3\nx\ny"
    assert text_of('<body><nav><ul><li>Menu</ul></nav><header>Top</header><article><header><h1>Title</h1></header><!-- <p>no</p> --><p title="a>b">yes</p><script>x="<p>no</p>"</script><aside>no</aside></article><footer>no') == "Title\nyes"
    assert text_of('<main class="has-sidebar"><p>yes</p><div class="ad-slot">no</div><form>no</form><section id="comments"><article>no</article></section><p hidden>no<p style="display: none">no</main>') == "yes"
    assert text_of('<div class="sidebar wrap"><article><p>yes</article><p>no</div>') == "yes"
    assert text_of("<p>plain &#233; &nbsp; text\n\n  here</p><table><tr><td>1<td>2<tr><td>3</table>") == "plain é text here\n1\n2\n3"
    assert text_of("<p>it's <em class=ad>fine</em></p><div data-class='ad'>kept</div>") == "it's fine\nkept"
    assert text_of(None) == text_of("") == text_of(" \n") == text_of("<p>") == text_of("<!-- never closed <p>x") == text_of("<script>never closed <p>x") == ""


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a b='", "<!--", "<p>", "<div>", "</p>", "<", "&", "<li><ul>", "<table><td>", "x <b"])
def test_linear(piece):
    began = time.perf_counter()
    pages.blocks(piece * 40000)
    assert time.perf_counter() - began < 10


def site(i, article="div"):
    inner = " ".join(f"word{i}{j} here and there" for j in range(5 + i % 3))
    return f'<html><body><div class="x1"><a href=/a>One</a> <a href=/b>Two</a></div><div class="x2">We set small files on your disk.</div><{article} class="x3"><h2>Title {i}</h2><p>{inner}</p><p>{inner} again</p></{article}><div class="x4">Made by people &copy; us</div></body></html>'


def test_templates(spark, monkeypatch):
    """A site whose classes say nothing: constant and linked slots go, what differs stays; on both ways to join."""
    rows = [(i, "https://u@Site.example:80/p", site(i), "s", 1) for i in range(12)] + [(3, "https://u@Site.example:80/p", site(3), "s", 1)]
    rows += [(100, None, None, "s", 1), (101, "", "", None, None), (102, "no url", "<p>alone</p>", "s", 1), (103, "http://site.example", "<main>other layout</main>", "s", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, slots int").repartition(3)
    want = {i: "\n".join([f"Title {i}", *[" ".join(f"word{i}{j} here and there" for j in range(5 + i % 3)) + end for end in ("", " again")]]) for i in range(12)} | {100: "", 101: "", 102: "alone", 103: "other layout"}
    for limit in (pages.BROADCAST, 0):
        monkeypatch.setattr(pages, "BROADCAST", limit)
        monkeypatch.setattr(pages, "HOT", 3)
        found = pages.extract(df)
        assert found.columns == [*df.columns, "main_text"]
        got = found.collect()
        assert sorted((r["page_id"], r["main_text"]) for r in got) == sorted((r[0], want[r[0]]) for r in rows)
    assert pages.extract(df.limit(0)).count() == 0


def test_classes(spark):
    """Classes and vectors against their definition: tokens whose counts agree on every page."""
    texts = [site(i) for i in range(6)]
    counted = pages.tokens(spark.createDataFrame([(t,) for t in texts], "html string").repartition(4), F.lit("h"), F.col("html"))
    vectors = defaultdict(dict)
    for i, t in enumerate(texts):
        runs, elements = pages.blocks(t)
        for key, n in Counter([(e.path, pages.ELEMENT) for e in elements] + [(b.path, pages._run_token(b)) for b in runs]).items():
            vectors[key][i] = n
    want = defaultdict(set)
    for key, v in vectors.items():
        want[tuple(sorted(v.items()))].add(key)
    got = defaultdict(set)
    for r in counted.where(~F.col("token").isin(pages.PAGE, pages.RUNS)).collect():
        got[r["pages"], r["occurs"], r["high"], r["low"]].add((r["path"], r["token"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_nested():
    import numpy as np

    a = lambda *x: np.array(x, float)
    assert pages._nested(a(1, 2, 9), a(3, 4, 8)) and pages._nested(a(3, 4), a(1, 9)) and pages._nested(a(1, 2), a(3, 4))
    assert not pages._nested(a(1, 5), a(3, 9))


# importance resampling ---------------------------------------------------------------------------------------------------


def brute_scores(docs, targets, run):
    def features(t):
        w = FEATURE.findall((t or "").translate(LOW))
        return [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for _, x in rows for f in features(x)) for rows in (docs, targets))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10000) / ((s[b] + 1) * (sum(t.values()) + 10000))))
    out = []
    for d, x in docs:
        f = features(x)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(y)) for y in f)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(FEATURE.findall((x or "").translate(LOW)))))
    return out


KEY = lambda r: tuple((v is None, v) for v in r)


def test_importance(spark, folder):
    rows = brute_scores(documents(spark, folder), list(enumerate([*QUERIES, QUERIES[0], "word"])), 1)
    drawn = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], -r[1], -r[2]))
    n = 10 * len(drawn) // 100
    want = sorted([(*r[:4], i + 1) for i, r in enumerate(drawn[:n])] + [(*r[:4], None) for r in drawn[n:]] + [(*r[:4], None) for r in rows if r[4] < 20], key=KEY)
    assert sorted(map(tuple, importance.op12_importance(spark, folder).collect()), key=KEY) == want


def test_importance_settings(spark, docs, empty, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    want = sorted((r[:4] for r in brute_scores(documents(spark, folder), [(0, q) for q in [*QUERIES, QUERIES[0], "word"]], 2)), key=KEY)
    scored = importance.score(docs, items, run=2)
    assert sorted(map(tuple, scored.select("doc_id", "n_features", "weight", "score").collect()), key=KEY) == want
    assert scored.columns == [*docs.columns, "n_features", "weight", "score", "eligible"]
    some = importance.draw(docs.withColumn("row", F.lit(1)), items, percent=50)
    top = importance.score(docs, items).where("eligible").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")).collect()
    assert some.columns == [*docs.columns, "row"] and {r["doc_id"] for r in some.collect()} == {r["doc_id"] for r in top[: len(top) // 2]}
    assert importance.draw(empty, items).count() == 0 == importance.score(empty, items).count()
    assert importance.score(docs, items.limit(0)).count() == docs.count()


def test_ranked(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), "id").repartition(5)
    got = importance.ranked(df, [F.desc("a"), F.asc("id")], "place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 1001)) and [(r["a"], r["id"]) for r in got] == sorted(((i % 7, i) for i in range(1000)), key=lambda r: (-r[0], r[1]))


# ranked search -----------------------------------------------------------------------------------------------------------


def brute_search(docs, queries, k):
    terms = [TERM.findall((t or "").translate(LOW)) for _, t in docs]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    counts = [Counter(t) for t in terms]
    df = Counter(t for c in counts for t in c)
    out = []
    for item, q in queries:
        scores = []
        for (d, _), t, c in zip(docs, terms, counts, strict=True):
            m = 75 + 25 * len(t) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1000000000 * c[x] // (1000 * c[x] + 12 * m)) for x in TERM.findall((q or "").translate(LOW)) if x in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda r: (r[0], r[1], r[2] or 0))[:k])]
    return sorted(out, key=KEY)


def test_search(spark, folder, items):
    want = brute_search(documents(spark, folder), [(r[0], r[1]) for r in items.collect()], 20)
    assert sorted(map(tuple, wavelet.op13_search(spark, folder).collect()), key=KEY) == want


@pytest.mark.parametrize("shard,block", [(1, 1), (50, 1 << 18)])
def test_search_settings(spark, docs, items, empty, shard, block):
    shards, n = wavelet.index(docs.repartition(7), shard)
    assert shards.count() > 3
    want = brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r[0], r[1]) for r in items.collect()], 3)
    assert sorted(map(tuple, wavelet.top(shards, n, items, k=3, block=block).collect()), key=KEY) == want
    shards, n = wavelet.index(empty)
    assert (shards.count(), n) == (0, 0) and wavelet.top(shards, n, items).count() == 0 == wavelet.top(shards, n, items.limit(0)).count()


def test_trees(monkeypatch):
    """Each level of a tree groups postings by the leading bits of their documents, in order of impact; searches are exact in any order."""
    import numpy as np

    rng = np.random.default_rng(5)
    doc, term, tf = (rng.integers(0, n, 4000) for n in (37, 90, 9))
    pairs = {(t, d): n + 1 for d, t, n in zip(doc, term, tf, strict=True)}
    term, doc, tf = (np.array(x) for x in zip(*[(t, d, n) for (t, d), n in sorted(pairs.items())], strict=True))
    lengths = rng.integers(1, 500, 37)
    row = wavelet.build(list(range(37)), lengths, doc.astype(np.int32), term.astype(np.uint64), tf, 37, int(lengths.sum()))
    shard = wavelet.opened(row, np.arange(0, 90, 2).astype(np.uint64))
    for t, a, b in zip(shard.terms.tolist(), shard.starts, shard.ends, strict=True):
        mine = sorted(((-int(wavelet.impacts(tf[i : i + 1], lengths[doc[i : i + 1]], 37, int(lengths.sum()))[0]), int(doc[i])) for i in np.flatnonzero(term == t)))
        for level, values in enumerate(shard.impacts):
            assert values[a:b].tolist() == [-s for s, d in sorted(mine, key=lambda x: x[1] >> len(shard.zeros) - level)]
    opened = wavelet.opened(row, np.unique(term).astype(np.uint64))
    impact = wavelet.impacts(tf, lengths[doc], 37, int(lengths.sum()))
    for group in (1, 3, 256):
        monkeypatch.setattr(wavelet, "GROUP", group)
        for n in (1, 2, 9, 40):
            asked = np.unique(rng.integers(0, 95, n))
            weights = rng.integers(0, 50, len(asked))
            scores = Counter()
            for t, d, i in zip(term.tolist(), doc.tolist(), impact.tolist(), strict=True):
                scores[d] += i * int(weights[asked == t].sum())
            want = sorted((-s, False, d) for d, s in scores.items() if s > 0)
            assert wavelet.search(opened, asked.astype(np.uint64), weights, [], 5) == want[:5]
            best = [(want[0][0] if want else -1, False, -7)] * 2
            assert wavelet.search(opened, asked.astype(np.uint64), weights, best, 3) == sorted(best + want)[:3]
