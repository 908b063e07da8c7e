"""Text functions as column expressions, inside Spark's own engine."""

from __future__ import annotations

import datetime as dt
import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tokenizer's contract: what a word is, and where an identifier is split.
TOKEN = r"[\p{L}\p{N}_]+"
_BOUNDARY = r"_|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])"

#: Words that carry no meaning in a query.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "have", "has", "had", "where", "what", "which", "who", "whom", "how", "when",
    "why", "in", "on", "of", "to", "for", "and", "or", "not", "with", "by", "at", "from", "this", "that", "these", "those", "it", "its", "as", "i", "we", "you", "my", "our",
    "your", "can", "could", "should", "would", "will", "into", "about", "there", "here", "any", "some", "all", "me", "us", "them",
)


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores, in order; null has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def first_words(text: Column, most: int) -> Column:
    """The first ``most`` words as they stand; the rest of a text is not looked at. Null stays null."""
    begin = F.regexp_extract(text, rf"^[^\p{{L}}\p{{N}}_]*+((?:{TOKEN}+[^\p{{L}}\p{{N}}_]*+){{0,{most}}})", 1)
    return F.regexp_extract_all(begin, F.lit(TOKEN), F.lit(0))


def split_identifiers(text: Column) -> Column:
    """Each word and, where it has parts (case, digits, underscores), its lower-cased parts after it."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def parts(word: Column) -> Column:
        # one pattern finds where to split, and a single character is split at without one
        cut = F.transform(F.array(F.regexp_replace(word, _BOUNDARY, "_")), lambda c: F.when(F.contains(c, F.lit("_")), F.filter(F.split(c, "_"), lambda p: p != "")))
        found = F.transform(cut, lambda f: F.when(F.size(f) > 1, F.concat(F.array(word), F.transform(f, lambda p: F.lower(p)))))
        return F.coalesce(found[0], F.array(F.lower(word)))

    return F.array_join(F.flatten(F.transform(words, parts)), " ")


def terms(text: Column) -> Column:
    """Distinct query terms without stop words, or all terms if there are only stop words."""
    every = F.array_distinct(tokens(text))
    kept = F.array_except(every, F.array(*map(F.lit, STOP_WORDS)))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def query_terms(text: str) -> list[str]:
    """terms() for a query that the driver has."""
    every = list(dict.fromkeys(t.lower() for t in re.findall(r"\w+", text or "")))
    return [t for t in every if t not in STOP_WORDS] or every


def query_tokens(text: str) -> list[str]:
    """The words of a query that the driver has, with the parts of identifiers, lower-cased, as split_identifiers gives them."""
    out = []
    for word in re.findall(r"\w+", text or ""):
        parts = [p.lower() for p in re.split(_BOUNDARY, word) if p]
        out += [word.lower(), *parts] if len(parts) > 1 else [word.lower()]
    return out


def identifier_words(text: Column, most: int = 400) -> Column:
    """Words that look like identifiers: three letters or more, with a capital or an underscore; distinct."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & F.regexp_like(w, F.lit("[A-Z_]")))), 1, most)


def signature(text: Column) -> Column:
    """Distinct tokens in order of code points, joined: equal for queries of the same words."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(F.lower(text)))), " ")


def normalize_title(title: Column) -> Column:
    """Lower case, with single blanks for all that is neither letter nor digit."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def normalize_tags(tags: Column) -> Column:
    """Trimmed, lower-cased, distinct, without empty ones; first-seen order."""
    cleaned = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    return F.array_distinct(F.filter(cleaned, lambda t: t != ""))


def normalize_files(files: Column) -> Column:
    """Forward slashes, no leading one, distinct, without empty ones."""
    cleaned = F.transform(F.coalesce(files, F.array().cast("array<string>")), lambda f: F.ltrim(F.regexp_replace(F.trim(f), r"\\", "/"), F.lit("/")))
    return F.array_distinct(F.filter(cleaned, lambda f: f != ""))


def normalize_repo(value: Column) -> Column:
    """owner/name from a hosting URL, an ssh address or owner/name; else the last part of a path; lower case."""
    trimmed = F.trim(value)
    url = r"(?i)^(?:https?://|git@)?(?:www\.)?github\.com[:/]([\w.-]+)/([\w.-]+?)(?:\.git)?/?$"
    owner = F.regexp_extract(trimmed, url, 1)
    tail = F.element_at(F.split(F.regexp_replace(trimmed, r"[/\\]+$", ""), r"[/\\]"), -1)
    named = F.when(owner != "", F.concat_ws("/", owner, F.regexp_extract(trimmed, url, 2))).when(F.regexp_like(trimmed, F.lit(r"^[\w.-]+/[\w.-]+$")), trimmed).otherwise(tail)
    return F.when(F.length(trimmed) > 0, F.lower(named))


def truncate(text: Column, most: int) -> Column:
    """The first ``most`` code points, and an ellipsis if there were more; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("\u2026")))


def one_line(text: Column) -> Column:
    """A text on one line: without carriage returns, blanks for line ends, trimmed; null is empty."""
    return F.trim(F.translate(F.coalesce(text, F.lit("")), "\n\r", " "))


def first_line(text: Column) -> Column:
    """What stands before the first line end, trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), "\r", ""))


def listed(values: Column) -> Column:
    """An array as a list with commas, or None where there is nothing to list."""
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, F.array_join(values, ", ")).otherwise("None")


def split_list(text: Column) -> Column:
    """What listed() wrote, or a list with semicolons, as an array; None and blanks are empty."""
    parts = F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.lower(F.trim(text)) == "none", F.array().cast("array<string>")).otherwise(F.coalesce(parts, F.array().cast("array<string>")))


def since(text: str | None, now: dt.datetime) -> dt.datetime | None:
    """The moment that "24h", "7d", "2w" or "3m" (calendar months) before ``now`` means, or an ISO one; nothing is None."""
    text = (text or "").strip()
    if not text:
        return None
    if m := re.fullmatch(r"(\d+)([hdwm])", text, re.IGNORECASE | re.ASCII):
        n, unit = int(m[1]), m[2].lower()
        if unit != "m":
            return now - dt.timedelta(hours=n * {"h": 1, "d": 24, "w": 168}[unit])
        years, month = divmod(now.year * 12 + now.month - 1 - n, 12)
        first = now.replace(year=years, month=month + 1, day=1)
        last = (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
        return first.replace(day=min(now.day, last.day))
    try:
        found = dt.datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"Neither a duration such as 7d, 24h or 2w nor an ISO date: {text!r}") from None
    return found if found.tzinfo is None else found.astimezone(dt.UTC).replace(tzinfo=None)


def _marked() -> tuple[str, str]:
    """Latin letters with a diacritic, and the same without it, by Unicode's own decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    plain = [(a, b[0]) for a, b in pairs if len(b) > 1 and unicodedata.combining(b[1])]
    return "".join(a for a, _ in plain), "".join(b for _, b in plain)


def fold_marks(text: Column) -> Column:
    """A text without the diacritics of its Latin letters."""
    return F.translate(text, *_marked())


REDACTED = "[REDACTED]"
#: Pattern and replacement, applied in this order; RE2 reads them like Java (with \\1 for $1).
SECRET_SHAPES = (
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", REDACTED),
    (r"([a-zA-Z][a-zA-Z0-9+.-]*://[^\s:/@]+:)[^\s@/]+@", "$1" + REDACTED + "@"),
    (r"(?i)(bearer\s+)[a-z0-9._~+/=-]{16,}", "$1" + REDACTED),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", REDACTED),
    (r"\bsk-[A-Za-z0-9_-]{20,}", REDACTED),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}", REDACTED),
    (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", REDACTED),
    (r"""(?i)(\b[a-z0-9_]*(?:password|passwd|pwd|secret|api_?key|access_?key|token)\s*[=:]\s*["']?)[^\s"';,\[]{6,}""", "$1" + REDACTED),
)


def redact(text: Column) -> Column:
    """The text with all that looks like a credential replaced; names of keys stay; null stays null."""
    for shape, put in SECRET_SHAPES:
        text = F.regexp_replace(text, shape, put)
    return text


#: What a text must hold for any of SECRET_SHAPES to be found in it: as it stands, and in lower case.
_SECRET_SIGNS = ("-----BEGIN ", "://", "eyJ", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "AKIA", "ASIA")
_SECRET_NAMES = ("bearer", "password", "passwd", "pwd", "secret", "apikey", "api_key", "accesskey", "access_key", "token")


def redact_rare(text: Column) -> Column:
    """As redact(), sooner for a short text, as a column by itself, that mostly holds no sign of a credential."""
    signs = [F.contains(text, F.lit(s)) for s in _SECRET_SIGNS] + [F.contains(F.lower(text), F.lit(s)) for s in _SECRET_NAMES]
    return F.when(functools.reduce(Column.__or__, signs), redact(text)).otherwise(text)


def contains_secret(text: Column) -> Column:
    """Whether redact would replace anything."""
    hits = [F.regexp_like(text, F.lit(shape)) for shape, _ in SECRET_SHAPES]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def redact_connection(text: Column) -> Column:
    """A connection string without its password."""
    return F.regexp_replace(text, r"(?i)\b(password|pwd|pass)\s*=\s*[^;]*", "$1=***")


def fold_namespace(name: Column, depth: int) -> Column:
    """The first ``depth`` parts of a dotted name."""
    return F.substring_index(name, ".", depth)


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression; a bare word matches names that hold it, at any depth."""
    if not re.search(r"[*?/]", pattern):
        pattern = f"**/*{pattern}*"
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] in "*?":
            out, i = out + {"*": "[^/]*", "?": "[^/]"}[pattern[i]], i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"(?i)^{out}$"
