"""Personal data: patterns propose spans, checksums confirm them, words nearby move their scores."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, pattern, table

#: Kinds that always count, in the order in which equal starts are listed; then those of the method.
BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "birth", "passport")
#: A span of MORE is reported from this score on.
LEAST = 0.6
#: Characters before and after a span in which context words count.
NEAR = 40

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

_DOMAIN = pattern(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# No match can begin inside a run of digits (the run's start would match as well), so the look-behinds change
# no result; they keep long runs of digits from being tried at each digit.
_DIGIT = pattern(r"[0-9]")
_IP = pattern(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = pattern(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = pattern(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = pattern(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = pattern(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_BIRTH = pattern(r"(?<![0-9.\x2F-])(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])(?P<s>[.\x2F])(?:0?[1-9]|1[0-2])(?P=s)(?:19|20)[0-9]{2})(?![0-9.\x2F-])")
_PASSPORT = pattern(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])")
_NOT_DIGIT = pattern(r"[^0-9]+")

#: Characters of a bank account's number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
#: Score of a span that its validator has confirmed, and the words nearby that raise or lower it by CONTEXT. Spans of MORE are
#: kept or not by it: an IBAN is, unless a word speaks against it; the others only with a word for them, and none against.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "birth": 0.3, "passport": 0.3}
CONTEXT = 0.3
_UP = {
    "email": pattern(r"(?i)mail|contact|write"),
    "ip": pattern(r"(?i)\bip\b|host|server|address"),
    "card": pattern(r"(?i)card|visa|credit|payment|carte|karte|tarjeta"),
    "phone": pattern(r"(?i)phone|call|tel|mobile|fax"),
    "iban": pattern(r"(?i)iban|account|bank|konto|compte|cuenta"),
    "ssn": pattern(r"(?i)\bssn\b|social security"),
    "birth": pattern(r"(?i)\bborn\b|birth|\bdob\b|geboren|geburt|naissance|nacid[oa]|nacimiento"),
    "passport": pattern(r"(?i)passport|passeport|reisepass|pasaporte"),
}
_DOWN = pattern(r"(?i)example|sample|test|dummy|version|isbn|order")


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The length for its country, and the check digits of bank accounts: moved to the end and letters read as numbers, it leaves 1."""
    compact = iban.replace(" ", "")
    if len(compact) != IBAN_LENGTHS.get(compact[:2]):
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _emails(text: str):
    """Matches of local part, @ and domain, from the left; found from each @, so in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def propose(text: str):
    """(kind, start, end) of all confirmed spans, in code points, by kind."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", *m.span()
    for kind, shape in (("ssn", _SSN), ("birth", _BIRTH), ("passport", _PASSPORT)):
        for m in shape.finditer(text):
            yield kind, *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, more with a word for it nearby, less with a word against it."""
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    return round(min(1.0, PRIOR[kind] + CONTEXT * bool(_UP[kind].search(near)) - CONTEXT * bool(_DOWN.search(near))), 2)


def find_spans(text: str | None) -> list[dict]:
    """All spans of a text by start, then kind. Those of BASE stay at any score; a null text has none."""
    order = {k: i for i, k in enumerate(BASE + MORE)}
    found = [{"kind": k, "start": s, "end": e, "score": score(text, k, s, e)} for k, s, e in propose(text or "")]
    return sorted((x for x in found if x["kind"] in BASE or x["score"] >= LEAST), key=lambda x: (x["start"], order[x["kind"]]))


@F.arrow_udf(SPANS)
def pii_spans(texts: pa.Array) -> pa.Array:
    """find_spans over an Arrow batch."""
    return pa.array([find_spans(t) for t in texts.to_pylist()], _ARROW)


def find_pii(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """Add ``name``: an array of (kind, start, end, score) over each whole text, code points, end exclusive.

    Row by row, without a shuffle; equal rows give equal spans, no rows give none, and a null or empty text an
    empty array. An existing column of that name is replaced.
    """
    return docs.withColumn(name, pii_spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets; of overlapping spans the first is replaced.

    Null, empty and clean texts stay, repeated rows give repeated rows, no rows give none; columns as given.
    """
    (spans,) = fresh(docs, "spans")

    def step(a, s):
        take = s["start"] >= a["at"]
        kept = F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(take, kept).otherwise(a["out"]).alias("out"), F.when(take, s["end"]).otherwise(a["at"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(F.col(text)))))
    return find_pii(docs, text, spans).withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(text))).select(*docs.columns)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document."""
    rows = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    strength = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return rows.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_found"), strength.alias("score"))
