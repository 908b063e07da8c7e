"""Secret scans: patterns propose findings, a random forest on their features removes the false ones.

The forest is trained by Spark's own trainer on labelled findings and then written out as one SQL expression over
a finding's features, so scanning is a row-by-row projection.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, keep_where, running_sums, table

#: Labelled findings to train on at most; more are thinned by a hash of the finding, not by place.
TRAIN_ROWS = 4000
TREES, DEPTH, SEED = 15, 5, 7
#: A finding is a secret from this mean vote on.
LEAST = 0.5
#: Characters before and after a finding whose words are looked at.
NEAR = 48

# Token characters, key words, and shapes of well-known credentials.
_RUN = "[A-Za-z0-9+/_-]"
_FIRST = rf"(?:(?<!{_RUN})|\G)"
_KEY = r"(?i:password|passwd|pwd|secret(?:[_-]?key)?|api[_-]?key|access[_-]?key|token)[\"']?\s*+[=:]\s*+[\"']?"
_VALUE = r"""[^\s"';,\[]{6,}+"""
_PEM = r"(?s:-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----.*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)"
_KNOWN = r"(?=[Agsxe])(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"
#: Before a value, part of its match: the user of an address, "bearer", or a key's name and sign.
_LEAD = rf"(?:://[^\s:/@]*+:(?=[^\s@/])|(?i:bearer)\s++|{_RUN}*{_KEY}(?={_VALUE}))"
#: Key blocks, well-known shapes, passwords in addresses, bearer tokens, values of keys, then any long run of
#: token characters, which stops where a well-known shape begins. A finding is its match without _LEAD.
SHAPES = (
    _PEM,
    _KNOWN,
    r"://[^\s:/@]*+:[^\s@/]++(?=@)",
    rf"(?={_RUN}){_FIRST}(?:(?i:bearer)\s++[A-Za-z0-9._~+/=-]{{16,}}+|(?={_RUN}++[\"']?\s*+[=:]){_RUN}*{_KEY}{_VALUE}|(?={_RUN}{{16}})(?:(?!{_KNOWN}){_RUN}){{16,}}+={{0,2}})",
)
#: Words that texts and names are made of and secrets are not, and words beside true and false findings.
DICTIONARY = (
    "about", "access", "account", "action", "active", "address", "admin", "after", "again", "agent", "alert", "allow", "also", "amount", "answer", "apply", "archive", "array", "asset", "async",
    "author", "backup", "balance", "batch", "before", "block", "branch", "buffer", "build", "button", "cache", "call", "cancel", "change", "changeme", "channel", "check", "child", "class", "client",
    "close", "cloud", "cluster", "code", "color", "column", "command", "commit", "common", "config", "connect", "content", "context", "control", "copy", "count", "create", "current", "custom", "data",
    "date", "debug", "default", "delete", "deploy", "detail", "device", "display", "document", "domain", "download", "dummy", "editor", "email", "enable", "engine", "entity", "entry", "error", "event",
    "example", "export", "factory", "false", "field", "file", "filter", "find", "first", "folder", "format", "forward", "frame", "from", "function", "global", "group", "handler", "hash", "header",
    "hello", "here", "history", "host", "image", "import", "index", "info", "input", "insert", "invalid", "item", "key", "label", "language", "last", "layout", "length", "level", "library", "license",
    "line", "link", "list", "load", "local", "login", "main", "manager", "master", "member", "memory", "message", "method", "mode", "model", "module", "name", "network", "node", "none", "null",
    "number", "object", "option", "order", "output", "package", "page", "parent", "password", "path", "placeholder", "please", "private", "process", "product", "profile", "public", "query", "queue",
    "read", "record", "release", "report", "request", "response", "result", "sample", "search", "secret", "section", "select", "server", "service", "session", "setting", "source", "state", "status",
    "stop", "store", "stream", "string", "style", "submit", "success", "summary", "support", "symbol", "system", "table", "target", "task", "template", "test", "text", "thread", "time", "title", "token",
    "total", "track", "transfer", "type", "undefined", "under", "union", "unique", "unit", "update", "upload", "user", "valid", "value", "variable", "vector", "version", "view", "visible", "volume", "wait",
    "warning", "watch", "weight", "widget", "width", "window", "with", "word", "work", "worker", "wrapper", "write", "year", "your", "zone",
)
FOR_WORDS = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key", "auth", "credential", "bearer")
AGAINST_WORDS = ("example", "sample", "sha1", "sha256", "md5", "checksum", "hash", "commit", "uuid", "digest", "integrity", "revision", "etag")
FILLERS = ("example", "sample", "dummy", "placeholder", "changeme", "your", "xxxx", "0000", "insert", "sha256-", "sha384-", "sha512-")
TEST_PATHS = ("test", "example", "sample", "doc", "fixture", "mock", "spec")

FEATURES = ("length", "digits", "uppers", "switches", "letter_pairs", "distinct", "coverage", "longest_run", "path", "near_for", "near_against", "assigned", "known", "code", "joined", "classes", "marks", "filler")


def _any_of(text: Column, listed: tuple[str, ...]) -> Column:
    return F.regexp_like(text, F.lit("(?i)(" + "|".join(w.replace("-", r"\-") for w in listed) + ")")).cast("double")


def _test_path(path: Column) -> Column:
    """Whether a word of a path is one of TEST_PATHS, or its plural."""
    begins = r"(?:(?<![A-Za-z])|(?<=[a-z0-9])(?=[A-Z]))"
    return F.regexp_like(path, F.lit(begins + "(?i:" + "|".join(TEST_PATHS) + ")s?(?![a-z])")).cast("double")


def pair_odds() -> list[float]:
    """For each two letters in turn, a to z, the logarithm of how much likelier they follow in DICTIONARY's words than by chance."""
    seen = Counter(w[i : i + 2] for w in DICTIONARY for i in range(len(w) - 1))
    every = sum(seen.values())
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [round(math.log((seen[x + y] + 0.5) * 676 / (every + 338)), 4) for x in letters for y in letters]


def _letter_pairs(finding: Column) -> Column:
    """The mean odds of a finding's adjacent letters, in any case; 0 if none are adjacent."""
    chars = F.split(F.lower(finding), "")
    code = lambda c: F.ascii(c) - 97
    letter = lambda c: code(c).between(0, 25)
    odds = F.array(*map(F.lit, pair_odds()))
    n = F.size(chars) - 1
    found = F.filter(F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda x, y: F.when(letter(x) & letter(y), F.get(odds, code(x) * 26 + code(y)))), lambda v: v.isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda t, v: t + v) / F.size(found)).otherwise(0.0)


def features(finding: Column, before: Column, after: Column, path: Column) -> Column:
    """FEATURES of a finding as a struct of doubles; null paths count as no test path."""
    n = F.greatest(F.length(finding), F.lit(1)).cast("double")
    share = lambda p: F.regexp_count(finding, F.lit(p)) / n
    plain = F.regexp_replace(F.lower(finding), "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", "")
    runs = F.regexp_extract_all(finding, F.lit(r"([A-Za-z])[A-Za-z]*"), F.lit(0))
    out = {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "switches": share(r"[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])"),
        "letter_pairs": _letter_pairs(finding),
        "distinct": F.size(F.array_distinct(F.split(finding, ""))) / n,
        "coverage": 1 - F.length(plain) / n,
        "longest_run": F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)) / n,
        "path": _test_path(F.coalesce(path, F.lit(""))),
        "near_for": _any_of(before, FOR_WORDS),
        "near_against": F.greatest(_any_of(before, AGAINST_WORDS), _any_of(after, AGAINST_WORDS)),
        "assigned": F.regexp_like(before, F.lit(r"[=:]\s*[\"']?$")).cast("double"),
        "known": F.regexp_like(finding, F.lit(f"^(?:{_PEM}|{_KNOWN})")).cast("double"),
        "code": share(r"[(){}<>*.]"),
        "joined": share(r"[/_-](?=[A-Za-z0-9])"),
        "classes": sum((F.regexp_like(finding, F.lit(p)).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", r"[!@#$%^&~]")), F.lit(0)),
        "marks": share(r"[!@#$%^&~]"),
        "filler": _any_of(finding, FILLERS),
    }
    return F.struct(*[out[k].cast("double").alias(k) for k in FEATURES])


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS, seed: int = SEED) -> DataFrame:
    """Labelled findings made by rule: (finding, before, after, path, label); half are secrets.

    Secrets are random hexadecimal, base-62 or base-64 strings of several lengths, prefixed tokens, key blocks and
    passwords, after key words, other names or signs, in prose or at a start of a line; bare hexadecimal is none. The others are
    placeholders, words, identifiers, expressions, numbers, digests and ids, also after key words, and every shape of
    secret under test, doc and fixture paths.
    """
    h = lambda salt: F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col("id")), 256)
    pick = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), (F.conv(F.substring(h(salt), 1, 7), 16, 10).cast("int") % len(values) + 1))
    number = lambda salt, low, high: F.conv(F.substring(h(salt), 1, 7), 16, 10).cast("int") % (high - low + 1) + low

    def cases(column: str, values: dict) -> Column:
        out = F.lit(None).cast("string")
        for keys, value in reversed(values.items()):
            out = F.when(F.col(column).isin(*keys), value).otherwise(out)
        return out

    base62 = lambda *salts: F.translate(F.base64(F.unhex(F.concat(*map(h, salts)))), "+/=", "abc")
    hexa, mixed = F.concat(h("x"), h("y")), base62("x", "y")
    digits = F.substring(F.translate(hexa, "abcdef", "012345"), F.lit(1), number("dg", 10, 24))
    base64 = F.base64(F.unhex(F.concat(h("x"), h("y"), h("z"), h("u"))))
    words = F.concat_ws("", *[pick(f"w{i}", ("user", "Name", "value", "default", "Config", "handler", "string", "Factory", "test", "example", "token", "the", "ment", "tion", "able", "list")) for i in range(6)])
    parts = F.concat_ws("/", *[pick(f"q{i}", ("src", "main", "controller", "build", "license", "module", "2024", "service", "v2", "index", "strata", "common", "linux", "x86", "release", "MAX", "BUFFER", "account")) for i in range(5)])
    parts = F.replace(parts, F.lit("/"), pick("ps", ("/", "_", "-", "/")))
    dashed = F.concat_ws("-", *[pick(f"d{i}", ("your", "secret", "here", "insert", "api", "key", "sample", "dummy", "change", "me", "foo", "bar")) for i in range(6)])
    uuid = F.concat_ws("-", *[F.substring(hexa, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    short = pick("sh", ("string", "required", "undefined", "changeme", "password", "example", "please", "optional", "must-be-set", "user_name", "forgotten", "authentication", "expired", "tokenizer", "invalid", "default"))
    code = F.concat(pick("c1", ("os.environ", "process.env.", "get", "config.", "${", "<", "{{", "settings.", "self.", "request.headers.", "*****")), pick("c2", ("TOKEN", "API_KEY", "dbPassword", "secret", "user")), pick("c3", ("()", "}", ">", "}}", ".get()", "***")))
    masked = F.concat(pick("p", ("AKIA", "ghp_", "sk-", "xoxb-")), F.when(F.col("id") % 4 < 2, F.concat(F.upper(F.substring(mixed, F.lit(1), number("mn", 6, 12))), F.lit("EXAMPLE"), pick("mx", ("", "", "KEY", "xxxx")))).otherwise(F.repeat(pick("r", ("x", "0", "X", "a")), 30)))
    known = cases("prefix", {(0,): F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), (1,): F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), (2,): F.concat(F.lit("sk-"), F.substring(mixed, F.lit(1), number("n", 20, 80))), (3,): F.concat(F.lit("xoxb-"), F.substring(mixed, F.lit(1), number("n", 12, 50))), (4,): F.concat(F.lit("eyJ"), F.substring(mixed, 1, 20), F.lit("."), F.substring(base62("z", "u"), 1, 40), F.lit("."), F.substring(mixed, 22, 40)), (5,): F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), base64, F.lit("\n"), base64, F.lit("\n-----END RSA PRIVATE KEY-----"))})
    password = F.concat(F.substring(mixed, F.lit(1), number("n", 5, 12)), pick("p1", ("!", "", "#", "7", "$9", "9x", "2")), pick("p2", ("", "k4", "Zq", "!", "31")))
    human = F.concat(pick("h1", ("hunter", "Summer", "correcthorse", "dragon", "Winter", "letmein", "Monkey", "qwerty")), pick("h2", ("", "_", "-", "!")), number("hn", 2, 99999).cast("string"), pick("h3", ("!", "", "#", "$x")), pick("h4", ("", "", "", "secret", "pass", "home", "Admin")))
    secret = cases("kind", {(0,): F.substring(hexa, F.lit(1), number("n", 16, 64)), (1, 2): F.substring(mixed, F.lit(1), number("n", 16, 80)), (3, 4): known, (5,): F.substring(base64, F.lit(1), number("bn", 40, 172)), (6,): password, (7,): human})
    other = cases("kind", {(0,): words, (1,): dashed, (2,): uuid, (3,): F.when(F.col("id") % 8 < 6, digits).otherwise(F.repeat(pick("r", ("x", "0", "ab", "-", "=")), 20)), (4,): F.when(number("di", 0, 3) == 0, F.concat(pick("ds", ("sha256-", "sha384-", "sha512-")), F.substring(base64, F.lit(1), pick("db", (43, 64, 86))))).otherwise(F.substring(hexa, F.lit(1), pick("dn", (32, 40, 64)))), (5,): parts, (6,): short, (7,): code, (8,): masked, (9,): cases("prefix", {(0, 1): F.substring(hexa, F.lit(1), number("n", 16, 64)), (2, 3): F.substring(mixed, F.lit(1), number("n", 16, 80)), (4,): password, (5,): F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36))})})
    base = spark.range(rows).withColumn("label", (F.col("id") % 2).cast("double")).withColumn("kind", F.when(F.col("label") == 1, number("k", 0, 8) % 8).otherwise(number("k", 0, 14)))
    base = base.withColumn("kind", F.when(F.col("kind") > 11, 4).otherwise(F.least("kind", F.lit(9)))).withColumn("prefix", number("pf", 0, 5)).withColumn("place", number("pl", 0, 3))
    signs = (' = "', "=", ": ", ' = "')
    keys = F.when(number("kb", 0, 7) == 0, pick("be", ("Authorization: Bearer ", "authorization: bearer ", "-H 'Authorization: Bearer "))).otherwise(F.concat(pick("kw", FOR_WORDS[:8]), pick("as", signs)))
    names = F.concat(pick("ow", ("aws", "OPENAI", "value", "x", "config", "github", "ACCOUNT", "stripe", "conn", "k")), pick("as", signs))
    prose = pick("pr", ("", "\n", "(", "[", "{", ">", "`", "\t", "we use ", "the value is ", "see ", "login with ", "it was ", "and ", "- "))
    address = F.concat(pick("ur", ("postgres", "https", "redis", "amqp")), F.lit("://"), pick("us", ("admin", "app", "root", "")), F.lit(":"))
    digest = F.concat(pick("aw", AGAINST_WORDS[2:]), pick("as", (" ", ": ", "=")))
    anywhere = F.when(F.col("place") == 0, keys).when(F.col("place") == 1, names).otherwise(prose)
    true_anywhere = F.when((F.col("place") == 1) & (number("ta", 0, 3) == 0), address).otherwise(anywhere)
    valued = F.when(F.col("kind") == 0, F.when(F.col("place") > 0, keys).otherwise(names)).when(F.col("place") > 1, keys).otherwise(address)
    true_before = F.when(F.col("kind").isin(0, 6, 7), valued).otherwise(true_anywhere)
    false_before = cases("kind", {(4,): F.when(F.col("place") == 0, prose).otherwise(digest), (2,): F.when(F.col("place") == 0, keys).otherwise(F.concat(pick("iw", ("id", "uuid", "request", "see")), pick("as", (" ", ": ", "=")))), (6, 7): F.when(F.col("place") == 0, address).otherwise(keys), (9,): F.when(F.col("place") == 0, prose).otherwise(keys)})
    before = F.when(F.col("label") == 1, true_before).otherwise(F.coalesce(false_before, anywhere))
    after = F.when(F.contains(before, F.lit("://")), pick("ah", ("@db.internal:5432/app", "@cache.example.com", "@10.0.0.5/x", "@mq.sample.org/q"))).otherwise(pick("af", ('" ', " and", "\n", '";', ")", "`", " is the token", " as password", "")))
    tests = F.concat(pick("pa", ("", "src/", "app/")), pick("pt", ("tests", "test", "docs", "fixtures", "examples", "spec", "mocks", "samples")), pick("pn", ("", "/a.py", "/config.yml")))
    plain = F.concat(pick("pa", ("src", "src1", "src2", "app", "config", "lib")), pick("pn", ("", "/a.py", "/config.yml")))
    path = F.when((F.col("label") == 0) & ((F.col("kind") == 9) | (number("pq", 0, 3) == 0)), tests).otherwise(plain)
    fields = {"finding": F.when(F.col("label") == 1, secret).otherwise(other), "before": before, "after": after, "path": path, "label": F.col("label")}
    return base.select(*[v.alias(k) for k, v in fields.items()])


def _tree_sql(node, name: str) -> str:
    """A fitted tree as nested CASE over the fields of struct ``name``: the share of secrets in the leaf."""
    if node.numDescendants() == 0:
        stats = node.impurityStats().stats()
        return repr(round(float(stats[1]) / max(1.0, float(stats[0]) + float(stats[1])), 6))
    split = node.split()
    return f"CASE WHEN {name}.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D THEN {_tree_sql(node.leftChild(), name)} ELSE {_tree_sql(node.rightChild(), name)} END"


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> str:
    """Fit the forest on labelled findings; returns its mean vote as SQL over a struct named f.

    At most about ``rows`` findings are used: beyond that, those with the least hash, alike on every run.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n = labelled.count()
    if n > rows:
        labelled = labelled.where(F.pmod(F.xxhash64("finding"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    made = labelled.select(features(F.col("finding"), F.col("before"), F.col("after"), F.col("path")).alias("f"), "label").select("f.*", "label")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(made).select("features", "label").coalesce(1)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(vectors)
    votes = [_tree_sql(t._call_java("rootNode"), "f") for t in model.trees]
    return "(" + " + ".join(votes) + f") / {len(votes)}D"


@lru_cache(8)
def _kept_forest(application: str, rows: int, seed: int) -> str:
    """The forest of labelled_findings, fitted once in an application: it depends on its parameters alone."""
    return train(labelled_findings(SparkSession.active(), rows, seed), rows, seed=seed)


def default_forest(spark: SparkSession) -> str:
    """What train() gives for labelled_findings."""
    return _kept_forest(spark.sparkContext.applicationId, TRAIN_ROWS, SEED)


def evaluate(forest: str, labelled: DataFrame, least: float = LEAST) -> tuple[float, float]:
    """(precision, recall) of a forest on labelled findings that it was not trained on."""
    f = features(F.col("finding"), F.col("before"), F.col("after"), F.col("path")).alias("f")
    rows = labelled.select(f, "label").selectExpr("label", f"{forest} >= {least} AS hit")
    both = F.count_if(F.col("hit") & (F.col("label") == 1))
    return tuple(rows.agg(both / F.count_if("hit"), both / F.count_if(F.col("label") == 1)).first())


_FINDING = "array<struct<start:int,end:int,finding:string,score:double>>"
#: Pieces of a text, gaps and matches in turn, that hold NEAR characters on a side of a finding: a match has five at least.
_SIDE = 2 * (NEAR // 5 + 1) + 1


def _scanned(docs: DataFrame, forest: str, path: str, out: str) -> DataFrame:
    """Add ``out``: what stands between and in the proposed findings of a text, in order, null where there are none.

    Each is (gap, lead, finding, start, end, score): gap is the text since the match before, lead what the match has
    before its finding. The last has the text after all matches as its gap, and no finding. All in time linear in the
    text: places are running sums of lengths, and surroundings are joined from the pieces next to a finding.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    shapes = "|".join(SHAPES)
    matches, parts, around = fresh(docs, "matches", "parts", "around")
    rows = docs.withColumn(matches, F.regexp_extract_all(text, F.lit(shapes), F.lit(0)))
    hit = F.size(matches) > 0
    # What split() leaves stands between the matches, so both tell where each match is.
    zipped = F.arrays_zip(F.split(text, shapes, -1).alias("gap"), F.col(matches).alias("match"))
    made = F.transform(zipped, lambda x: F.struct(x["gap"].alias("gap"), F.coalesce(x["match"], F.lit("")).alias("match"), F.regexp_replace(F.coalesce(x["match"], F.lit("")), F.lit("^" + _LEAD), F.lit("")).alias("finding")))
    rows = rows.withColumn(parts, F.when(hit, made))
    trimmed = lambda cut: F.flatten(F.transform(parts, lambda x: F.array(cut(x["gap"]), cut(x["match"]))))
    ends = running_sums(F.transform(parts, lambda x: F.length(x["gap"]) + F.length(x["match"])))
    rows = rows.withColumn(around, F.when(hit, F.struct(ends.alias("ends"), trimmed(lambda t: F.left(t, F.lit(NEAR))).alias("heads"), trimmed(lambda t: F.right(t, F.lit(NEAR))).alias("tails"))))
    pieces, scored = fresh(docs, "pieces", out)

    def described(x: Column, i: Column) -> Column:
        lead = F.left(x["match"], F.length(x["match"]) - F.length(x["finding"]))
        first = F.greatest(2 * i + 2 - _SIDE, F.lit(1))
        before = F.right(F.concat(F.array_join(F.slice(F.col(f"{around}.tails"), first, 2 * i + 2 - first), ""), lead), F.lit(NEAR))
        after = F.left(F.array_join(F.slice(F.col(f"{around}.heads"), 2 * i + 3, F.lit(_SIDE)), ""), F.lit(NEAR))
        end = F.get(F.col(f"{around}.ends"), i)
        f = F.when(x["finding"] != "", features(x["finding"], before, after, F.col(path).cast("string")))
        return F.struct(x["gap"].alias("gap"), lead.alias("lead"), x["finding"].alias("finding"), (end - F.length(x["finding"])).alias("start"), end.alias("end"), f.alias("f"))

    rows = rows.withColumn(pieces, F.when(hit, F.transform(parts, described)))
    vote = f"CASE WHEN x.f IS NOT NULL THEN round(element_at(transform(array(x.f), f -> {forest}), 1), 6) END"
    rows = rows.withColumn(scored, F.expr(f"transform({pieces}, x -> named_struct('gap', x.gap, 'lead', x.lead, 'finding', x.finding, 'start', x.start, 'end', x.end, 'score', {vote}))"))
    return rows.drop(matches, parts, around, pieces)


def find_secrets(docs: DataFrame, forest: str | None = None, path: str = "source", least: float = LEAST, name: str = "secrets") -> DataFrame:
    """Add ``name``: an array of (start, end, finding, score) for each proposed finding whose mean vote is ``least`` or more.

    Code points, end exclusive, by start; whole texts of any length, row by row, without a shuffle. Where shapes
    overlap, the longest from the leftmost start is one finding. ``forest`` is what train() returns (default: trained
    here on labelled_findings). A null or empty text has an empty array, a null path counts as none, equal rows get
    equal arrays, and no rows give none. An existing column of that name is replaced; all others stay, whatever their names.
    """
    forest = forest or default_forest(docs.sparkSession)
    docs = docs.drop(name)
    (out,) = fresh(docs, "scan")
    kept = F.filter(out, lambda x: x["score"] >= least)
    listed = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["finding"].alias("finding"), x["score"].alias("score")))
    return _scanned(docs, forest, path, out).withColumn(name, F.coalesce(listed, F.array().cast(_FINDING))).drop(out)


def redact_secrets(docs: DataFrame, forest: str | None = None, path: str = "source", least: float = LEAST) -> DataFrame:
    """The documents with each confirmed secret replaced by [SECRET]; columns as given, n_chars with the text's.

    Null, empty and clean texts stay as they are, repeated rows give repeated rows, no rows give none; texts may be
    of any length, and columns of any other names are carried.
    """
    forest = forest or default_forest(docs.sparkSession)
    out, done = fresh(docs, "scan", "clean")
    rows = _scanned(docs, forest, path, out)
    clean = F.array_join(F.transform(out, lambda x: F.concat(x["gap"], x["lead"], F.when(x["score"] >= least, "[SECRET]").otherwise(x["finding"]))), "")
    hit = F.coalesce(F.exists(out, lambda x: F.coalesce(x["score"] >= least, F.lit(False))), F.lit(False))
    rows = rows.withColumn(done, F.when(hit, clean))
    swap = {"text": F.coalesce(done, "text")}
    if "n_chars" in docs.columns:
        swap["n_chars"] = F.when(F.col(done).isNotNull(), F.length(done).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*[swap[c].alias(c) if c in swap else F.col(c) for c in docs.columns])


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each confirmed secret of every document: doc_id, start, end, finding, score."""
    rows = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    rows = keep_where(rows.select("doc_id", "secrets"), "size(secrets) > 0")
    return rows.select("doc_id", F.explode("secrets").alias("s")).select("doc_id", "s.start", "s.end", F.sha2("s.finding", 256).alias("finding_sha256"), "s.score")
