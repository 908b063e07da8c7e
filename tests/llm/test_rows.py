"""Queries that work row by row, against brute force on a small fixture."""

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm.common import stage
from strata.llm import licenses, media, mixing, packing, pii, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(x):
    return tuple((v is None, v) for v in x)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def pairs(sf_dir, spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_quality(spark, sf_dir):
    def brute(d, t):
        t = t or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)

    got = quality.op7_quality(spark, sf_dir)
    assert rows(got.select(*got.columns[:7])) == sorted((brute(*p) for p in pairs(sf_dir, spark)), key=key)
    assert not any(r["kept"] and r["base_failed"] for r in got.collect())


def test_quality_policies(spark, docs, empty):
    led = stage(quality.ledger(docs), "ledger")
    n = docs.count()
    by_rule = {r["rule"]: r for r in quality.ablations(led).collect()}
    assert set(by_rule) == {r.name for r in quality.RULES}
    for i, rule in enumerate(quality.RULES):
        assert by_rule[rule.name]["failed"] == led.where(f"failed & {1 << i} != 0").count()
        assert by_rule[rule.name]["kept_without"] == led.where(f"failed & {(1 << len(quality.RULES)) - 1 - (1 << i)} = 0").count()
    assert quality.apply_policy(led, quality.Policy("none", ())).where("not kept").count() == led.where("failed & 3 != 0").count() < n
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(empty).count() == 0 and quality.ledger(empty).count() == 0


def test_personal_data(spark, sf_dir):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fits(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])) % 10 == 0
        return kind != "phone" or 10 <= len(digits) <= 15

    def brute(d, t):
        t = (t or "") if len(t or "") < 50000 else ""  # the plain patterns take quadratic time on that one
        found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, t) if fits(k, m[0])]
        listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
        return d, *[sum(k == x[2] for x in found) for k in patterns], hashlib.sha256(listed.encode()).hexdigest()

    got = pii.op9_pii(spark, sf_dir)
    assert rows(got.select(*got.columns[:6])) == sorted((brute(*p) for p in pairs(sf_dir, spark)), key=key)
    assert any("iban" in r["spans"] for r in got.collect())


def test_added_spans_follow_their_context(spark):
    cases = {
        "my ssn is 123-45-6789": ["ssn"], "part 123-45-6789": [], "ssn 000-45-6789 or 123-00-6789": [], "the sample ssn 123-45-6789": [],
        "pay to DE89 3704 0044 0532 0130 00": ["iban"], "an example: DE89 3704 0044 0532 0130 00": [], "example account DE89 3704 0044 0532 0130 00": ["iban"], "iban DE89 3704 0044 0532 0130 0": [],
        "born 1984-02-29 in Rome": ["birth"], "on 1984-02-29 it rained": [], "geboren am 3.12.1990": ["birth"], "version of birth 1984-02-29": [], "dob 31/13/1990": [],
        "passport C01234567 expired": ["passport"], "order C01234567": [], "passport order C01234567": [],
    }
    rows = pii.find_pii(spark.createDataFrame([(t,) for t in cases], "text string")).collect()
    assert {r["text"]: [s["kind"] for s in r["spans"]] for r in rows} == cases
    strong, weak = (pii.find_spans(f"{w} 10.0.0.1")[0]["score"] for w in ("host", "version"))
    assert strong > weak


def test_redaction(docs, empty):
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[7] == "mail me at [EMAIL], [EMAIL]@d.e or @nobody; [IP] and 256.1.1.1 and [IP].5"
    assert out[3] == "word" and out[0] is None and pii.redact(empty).count() == 0
    assert pii.redact(docs).columns == docs.columns


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")


def test_licenses(spark, sf_dir, empty):
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}

    def brute(d, t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        found = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in found]
        return d, len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in found}))

    got = licenses.op6_licenses(spark, sf_dir)
    assert rows(got.select(*got.columns[:6])) == sorted((brute(*p) for p in pairs(sf_dir, spark)), key=key)
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[3]["score"] == 0 and licenses.find_licenses(empty).count() == 0


def test_whole_licenses(spark, docs):
    """Each text is told from those that share most of it, also between other words; half a text, or one without its phrases, is none."""
    own = [t for t in licenses.TEMPLATES if not t.base]
    texts = [(i, "Some code.\n// " + t.text.upper().replace(" ", "\n// ", 3) + " more words") for i, t in enumerate(own)]
    texts += [(100, " ".join(own[6].words[:12])), (101, own[-1].text.replace("noncommercial", "x")), (102, own[0].text.replace("version 2", "version 9"))]
    found = licenses.find_licenses(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {r["doc_id"]: {x["label"] for x in r["licenses"] if not x["base"]} for r in found.collect()}
    assert got == {i: {t.label} for i, t in enumerate(own)} | {100: set(), 101: set(), 102: set()}
    kept = licenses.find_licenses(docs.withColumn("words", F.lit("mine"))).select("words").distinct().collect()
    assert [r[0] for r in kept] == ["mine"]


#: Licenses as they are published: numbered or with bullets, wrapped, with holders and other names, behind marks of comments.
PUBLISHED = {
    "bsd-3-clause": [
        """Copyright (c) 2019, Ada Example
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        """// * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
// * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
//   documentation and/or other materials provided with the distribution.
// * Neither the name of the University of California, Berkeley nor the names of its contributors may be used to endorse or promote products
//   derived from this software without specific prior written permission.
// THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
// IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE
// LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
// SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
// WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN
// IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "bsd-2-clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY ACME CORP. OF SPRINGFIELD "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL ACME CORP. BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    ],
    "zlib": [
        """  This software is provided 'as-is', without any express or implied
  warranty.  In no event will the authors be held liable for any damages
  arising from the use of this software.

  Permission is granted to anyone to use this software for any purpose,
  including commercial applications, and to alter it and redistribute it
  freely, subject to the following restrictions:

  1. The origin of this software must not be misrepresented; you must not
     claim that you wrote the original software. If you use this software
     in a product, an acknowledgment in the product documentation would be
     appreciated but is not required.
  2. Altered source versions must be plainly marked as such, and must not be
     misrepresented as being the original software.
  3. This notice may not be removed or altered from any source distribution.

  Jean Example        Mark Example"""
    ],
    "mit": [
        """MIT (expat)

Copyright 2011-2020 The Project Contributors <team@project.example>

Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice (including the next
paragraph) shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE PROJECT CONTRIBUTORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    ],
    "apache-2.0": [
        """# Copyright 2020 The Example Authors. All Rights Reserved.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""
    ],
    "gpl-3.0": [
        """    Frobnicate 2 - does things to files
    Copyright (C) 2021  A. Hacker

    Frobnicate is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    Frobnicate is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with Frobnicate.  If not, see <https://www.gnu.org/licenses/>."""
    ],
}


def test_published_licenses(spark):
    """Texts that were not made of the templates are found as what they are, and as nothing else."""
    texts = [(f"{label} {i}", t) for label, ts in PUBLISHED.items() for i, t in enumerate(ts)]
    mixed = PUBLISHED["zlib"][0] + "\n\n" + "other words in between " * 40 + PUBLISHED["bsd-2-clause"][0]
    cut = [("head of bsd", PUBLISHED["bsd-3-clause"][0][:500]), ("words of zlib in another order", " ".join(sorted(PUBLISHED["zlib"][0].split())))]
    found = licenses.find_licenses(spark.createDataFrame([*texts, ("two", mixed), *cut], "name string, text string"))
    got = {r["name"]: sorted(x["label"] for x in r["licenses"] if not x["base"]) for r in found.collect()}
    assert got == {n: [n.rpartition(" ")[0]] for n, _ in texts} | {"two": ["bsd-2-clause", "zlib"], "head of bsd": [], "words of zlib in another order": []}


def test_media(spark, sf_dir, empty):
    def brute(d, t):
        raw = (t or "").encode()
        pay = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        return d, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])

    got = media.op3_media(spark, sf_dir)
    assert rows(got.select(*got.columns[:5])) == sorted((brute(*p) for p in pairs(sf_dir, spark)), key=key)
    values = {}
    for r in got.collect():
        assert values.setdefault(r["payload_sha256"] + str(r["n_bytes"]), r[1:]) == r[1:]
    assert media.media_columns(empty).count() == 0


def test_media_ranges_and_retries(spark, docs, tmp_path):
    folder = str(tmp_path / "a")
    n = media.write_archives(docs, folder).groupBy().sum("members").first()[0]
    spark.dataSource.register(media.ArchiveSource)
    small = spark.read.format("media_archive").option("rangebytes", 700).load(folder)
    assert small.count() == n == docs.count() and small.where("error is not null").count() == 0
    # Damage one member: its row tells so, the others are read.
    first = small.orderBy("archive", "member_offset").first()
    with open(f"{folder}/{first['archive']}", "r+b") as f:
        f.seek(first["member_offset"] + 60)
        f.write(b"?????")
    bad = spark.read.format("media_archive").load(folder).where("error is not null").collect()
    assert [(r["archive"], r["member_offset"]) for r in bad] == [(first["archive"], first["member_offset"])]
    with pytest.raises(Exception, match="damaged"):
        media.read_archives(spark, folder).collect()


def test_directories_are_tried_again(tmp_path):
    import io
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("0/1", b"x")
    whole, tries = (tmp_path / "a.zip").read_bytes(), []

    def opened(good_at):
        tries.append(1)
        if len(tries) < good_at:
            raise OSError("gone")
        return io.BytesIO(whole)

    assert [i.filename for i in media.read_directory(lambda: opened(3))] == ["0/1"] and len(tries) == 3
    tries.clear()
    with pytest.raises(OSError, match="gone"):
        media.read_directory(lambda: opened(9))
    assert len(tries) == media.TRIES


def test_media_leaves_no_archives(spark, docs):
    import os

    shared = spark.conf.get("spark.checkpoint.dir")
    before = {f for f in os.listdir(shared) if f.startswith("media-") and "columns" not in f}
    assert media.media_columns(docs).count() == docs.count()
    assert {f for f in os.listdir(shared) if f.startswith("media-") and "columns" not in f} == before


def test_packing(spark, sf_dir, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in pairs(sf_dir, spark):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(d, i, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = packing.op8_packing(spark, sf_dir)
    assert rows(got.select(*got.columns[:5])) == sorted(want, key=key)
    seq = {}
    for r in got.collect():
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seq.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(empty).count() == 0


def test_packing_special_tokens(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "a<|endoftext|>b", "<|endoftext| > no", "x <|endoftext|>" * 700]
    for t in texts:
        assert list(packing.encoder(packing.VOCABULARY).encode_to_numpy(t, allowed_special="all")) == tok.encode(t, add_special_tokens=False).ids
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).orderBy("doc_id", "piece").collect()
    for d, t in enumerate(texts):
        ids = b"".join(bytes(r["ids"]) for r in got if r["doc_id"] == d)
        assert ids == b"".join(x.to_bytes(4, "little") for x in [*tok.encode(t, add_special_tokens=False).ids, packing.END_ID])


def test_best_fit_counts():
    import random

    for seed in range(60):
        rnd = random.Random(seed)
        cap = rnd.choice([10, 64, 1024])
        counts = {rnd.randint(1, cap): rnd.randint(1, 50) for _ in range(rnd.randint(0, 30))}
        plan, made = packing.plan_best_fit(counts, cap)
        room: list[int] = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                best = min((r for r in room if r >= n), default=None)
                if best is None:
                    room.append(cap - n)
                else:
                    room.remove(best)
                    room.append(best - n)
        assert made == len(room)
        assert all(steps[0][0] == 0 and steps[-1][1] == counts[n] for n, steps in plan.items())


def test_sharding(spark, sf_dir, empty):
    got = sharding.op2_sharding(spark, sf_dir).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs(sf_dir, spark))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for s in range(16):
        mine = sorted(r["slot"] for r in got if r["shard"] == s)
        assert mine == list(range(len(mine)))
    shard = {}
    for r in got:
        assert shard.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_is_near_equal():
    plan = sharding.plan_shards([("a", 3 * 10**6)], [(1, 10**6, 10**8), (2, 999, 999 * 5000)], 16)
    assert max(plan.loads) - min(plan.loads) <= 5000
    exact = sharding._Loads(5)
    many = sharding._Loads(5)
    for size, n in ((100, 7), (30, 50), (7, 1000)):
        for _ in range(n):
            exact.put(size)
        many.put_many(size, n)
    assert sorted(x for x, _ in exact.heap) == sorted(x for x, _ in many.heap)


def test_shards_of_the_query_are_balanced(spark):
    """Many small groups, copies, and one group as large as an even share: it has a shard to itself, the others are level."""
    texts = [f"text {i} " * (1 + i % 9) for i in range(3000)] + ["copy"] * 300
    even = sum(len(t) + 1 for t in texts) // 15
    texts.append("x" * even)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shard_documents(rows, 16).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    loads = sorted(r["b"] for r in got)
    assert len(got) == 16 and max(loads) - min(loads) <= 0.01 * even
    assert [r["n"] for r in got if r["n"] == 1] == [1]


def test_written_shards(spark, docs, tmp_path):
    rows = sharding.assign_shards(stage(docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.length("text").alias("size")), "w"), 4)
    sharding.write_shards(rows, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and {r["shard"] for r in back.select("shard").distinct().collect()} == {r["shard"] for r in rows.select("shard").distinct().collect()}
    for f in (tmp_path / "s").glob("shard=*/*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(f)).collect()]
        assert slots == sorted(slots)


def test_packed_ids(spark, docs):
    """Sequences put together from the ids that pack() carries hold all tokens, in order."""
    got = packing.pack(docs, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    sequences = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert len(sequences.setdefault(r["sequence_id"], bytearray())) == 4 * r["offset"]
        sequences[r["sequence_id"]] += r["ids"]
    assert all(len(x) <= 4096 for x in sequences.values()) and sum(map(len, sequences.values())) == sum(len(r["ids"]) for r in got)


def test_tokens_equal_the_contract(spark):
    """All documents of the small table, as the contract's own tokenizer encodes them."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(packing.VOCABULARY).encode_to_numpy
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert list(encode(r["text"], allowed_special="all")) == tok.encode(r["text"], add_special_tokens=False).ids


def test_session_settings_stay(spark, docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    packing.pack(docs).count()
    pii.find_pii(docs).count()
    assert spark.conf.get(key, None) == before and spark.conf.get("spark.checkpoint.dir") == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_columns_of_any_name_are_kept(spark, docs, empty):
    """Names that operators use inside are a caller's own here, and stay as they are."""
    names = ("mark", "_mark", "id", "ranges", "cut", "words", "lines", "hashes", "spans", "scan", "clean", "matches", "parts", "around", "pieces", "_w", "_words", "_spans", "_secrets", "_row", "row")
    rows = docs.select("doc_id", "text", "source", "n_chars", *[F.lit(n).alias(n) for n in names if n != "spans"])
    from strata.llm import jaccard, secrets, substrings

    for f in (jaccard.keep_first, substrings.drop_repeats, lambda d: secrets.redact_secrets(d, "1D"), quality.keep_good, pii.redact, mixing.mix, lambda d: licenses.find_licenses(d)):
        out = f(rows)
        assert [c for c in out.columns if c in names] == [n for n in names if n != "spans"]
        assert out.select([n for n in names if n != "spans"]).distinct().count() <= 1
        assert f(rows.limit(0)).count() == 0


def test_mixing(spark, docs, empty, sf_dir):
    got = mixing.op5_mixing(spark, sf_dir).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got) and len(got) == docs.count()
    sizes = {r["source_size"] for r in got}
    total = sum(r["size"] for r in got)
    assert abs(sum(t for _, t in {(r["source_size"], r["target"]) for r in got}) - 1.5 * total) < 1 and len(sizes) == 4
    assert rows(mixing.op5_mixing(spark, sf_dir)) == sorted(map(tuple, got), key=key)
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(empty).count() == 0


def test_sharding_keeps_columns_of_any_name(spark):
    rows = [(i, f"d{i % 7}", 10 + i % 5, f"x{i}", i * 2, -1) for i in range(60)] + [(None, None, None, "y", None, -1)]
    df = spark.createDataFrame(rows, "doc_id long, digest string, size long, _g string, _size long, shard int")
    found = sharding.assign_shards(df, 3)
    assert found.columns == ["doc_id", "digest", "size", "_g", "_size", "shard", "slot"]
    got = found.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["_g"], r["_size"]) for r in got if r["doc_id"] is not None) == sorted((False, *r[:1], r[3], r[4]) for r in rows if r[0] is not None)
    assert len(got) == 61 and all(len({r["shard"] for r in got if r["digest"] == f"d{i}"}) == 1 for i in range(7))
    under = sharding.assign_shards(df.withColumnsRenamed({"digest": "_d", "size": "_s"}), 3, "_d", "_s")
    assert sorted((r["_d"] or "", r["shard"], r["slot"]) for r in under.collect()) == sorted((r["digest"] or "", r["shard"], r["slot"]) for r in got)
