"""Main text of web pages: templates of hosts deduced from equivalence classes of tokens, and the slots that remain.

Tokens are elements, told apart by their path of names and classes, and runs of text between block elements, told apart by
the path they stand on. A token's occurrence vector over its host's pages is kept as a fingerprint that adds up over tasks,
so nothing larger than a token's sums is ever gathered. Tokens of one host with equal vectors and support enough are an
equivalence class, an element counting as its two tags; a class of one run is no evidence. Classes are valid if they nest: of two that overlap in part the one
on fewer pages goes. Valid classes, in order of place, are the host's template. Its elements are slots, each with the sums of
what its runs held: a slot inside an article is content; on hosts without one a slot is content if most of its text is no
constant run of the template and no link, and undecided without text. A run belongs to the deepest decided slot on its path.

Words inside a run are not tokens: the main text keeps or drops whole blocks, so they could not change it.

Pages of hosts with less than MIN_PAGES pages, or that have no content slot of their host's template, go by their own
elements alone. Runs of an article are never taken for constant: copies of an article on many pages are still its text.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, small_batches, stage, table

#: A template is deduced from so many pages of a host at least, of tokens on this share of them.
MIN_PAGES = 4
SUPPORT = 0.5
#: A run of text is constant on this share of its host's pages.
CONSTANT = 0.8
#: Hosts of more pages are split when pages are joined with templates by host.
HOT = 50_000
#: Templates of so many slots and runs in all are broadcast (8 bytes each); more are joined by host.
BROADCAST = 4 << 20
#: Tokens whose sums a task holds before it passes them on.
HELD = 1 << 18

_MARK = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![A-Za-z])[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
_HINT = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

# Element names of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var br img wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: An element ends an open one of the second kind, unless one of the third is open inside.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody"), ("table",)),
}
P_SCOPE = ("td", "th", "table", "button", "caption", "object")
#: Elements that are never main text, and names of classes, ids and roles that say so.
DEAD = frozenset("head nav aside form button select template noscript dialog menu svg math object video audio canvas datalist applet search".split())
LAYOUT = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar share sharing social related recommended subscribe newsletter login signup search pagination pager complementary contentinfo skip".split())
TALK = frozenset("comment comments discussion replies disqus respond".split())

_DEAD, _LAYOUT, _TALK, _ARTICLE = 1, 2, 4, 8
#: What a slot is.
CONTENT, NO_CONTENT, UNDECIDED = 1, 0, -1

_SUMS = ("pages", "occurs", "high", "low", "place", "chars", "links")
_TOKENS = "host string, path long, token long, flags int, " + ", ".join(f"{c} long" for c in _SUMS)
#: Tokens that are no hashes: the page itself, an element, and all runs of a path together.
PAGE, ELEMENT, RUNS = 0, 1, 2


@dataclass(slots=True)
class Block:
    """A run of text: its place in the page, its path, its text, how much of it is links, and what the elements around it are."""

    place: int
    path: int
    text: str
    links: int
    flags: int


@dataclass(slots=True)
class Element:
    """An element: its place in the page, its path and its parent's, and what it and those around it are."""

    place: int
    path: int
    parent: int
    flags: int


def _number(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 16)
def _below(path: int, label: str) -> int:
    return _number(f"{path}/{label}")


@lru_cache(1 << 12)
def _described(name: str, attributes: str) -> tuple[str, int]:
    """(an element's name with its classes, without numbers; what name, classes, id, role and style say of it)."""
    flags = _DEAD if name in DEAD else _LAYOUT if name in ("header", "footer") else _ARTICLE if name in ("article", "main") else 0
    classes: list[str] = []
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), _html.unescape(value.strip("\"'"))
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            flags |= _DEAD
        elif key in ("class", "id", "role"):
            for part in value.split():
                words = {w.lower() for w in _HINT.findall(part)}
                if name not in ("html", "body"):
                    flags |= (_LAYOUT if words & LAYOUT and not flags & _ARTICLE else 0) | (_TALK if words & TALK else 0)
                if key == "role" and value in ("main", "article"):
                    flags |= _ARTICLE
            if key == "class":
                classes = sorted(re.sub(r"[0-9]+", "", c) for c in value.split())
    return ".".join([name, *classes]), flags


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """(runs of text, elements) of a page, in order; in time linear in it, whatever it is.

    Block elements part runs, others do not; references are decoded, white space becomes one space.
    """
    stack: list[tuple[str, int, int]] = []  # name, path, flags
    where: dict[str, list[int]] = defaultdict(list)
    runs: list[Block] = []
    elements: list[Element] = []
    buffer: list[str] = []
    linked, in_link = 0, False

    def last(names) -> int:
        return max((where[n][-1] for n in names if where[n]), default=-1)

    def cut(depth: int) -> None:
        while len(stack) > depth:
            where[stack.pop()[0]].pop()

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                path, flags = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
                runs.append(Block(len(runs) + len(elements), path, text, min(linked, len(text)), flags))
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not (stack and stack[-1][2] & _DEAD):
            text = _html.unescape(text) if "&" in text else text
            buffer.append(text)
            if in_link:
                linked += len(text.strip())

    at, end = 0, len(page)
    while at < end:
        m = _MARK.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name, closing = name.lower(), bool(m[1])
        if name in INLINE:
            if name == "br":
                buffer.append(" ")
            elif name == "a":
                in_link = not closing
            continue
        flush()
        in_link = False
        if closing:
            if where[name]:
                cut(where[name][-1])
            continue
        if name in CLOSES_P and where["p"] and where["p"][-1] > last(P_SCOPE):
            cut(where["p"][-1])
        if name in ENDS:
            ended, scope = ENDS[name]
            i = last(ended)
            if i > last(scope):
                cut(min(w[-1] for w in (where[n] for n in ended) if w and w[-1] > last(scope)))
        parent, over = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
        label, flags = _described(name, m[3].strip()) if m[3] else _described(name, "")
        if over & _ARTICLE and name == "header":
            flags &= ~_LAYOUT  # an article's own heading
        if flags & _ARTICLE and not flags & _TALK and not over & (_DEAD | _TALK):
            over &= ~_LAYOUT  # an article is main text even in an element that is named for its side bar
        path, flags = _below(parent, label), over | flags
        elements.append(Element(len(runs) + len(elements), path, parent, flags))
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
            where[name].append(len(stack))
            stack.append((name, path, flags | _DEAD))
        elif name not in VOID:
            where[name].append(len(stack))
            stack.append((name, path, flags))
    flush()
    return runs, elements


def _live(flags: int) -> bool:
    return not flags & (_DEAD | _LAYOUT | _TALK)


def _run_token(block: Block) -> int:
    return _number(f"{block.path}\0{block.text}") | 1 << 62  # never one of the small numbers above


def page_tokens(page: str, key: int) -> dict[tuple[int, int, int], list[int]]:
    """A page's tokens as (path, token, flags), with sums to add: pages, occurrences, two halves of the vector's fingerprint, first
    place, characters and characters in links."""
    runs, elements = blocks(page)
    found: dict[tuple[int, int, int], list[int]] = {(0, PAGE, 0): [1, 1, 0, 0, 0, 0, 0]}

    def add(token: tuple[int, int, int], place: int, chars: int = 0, links: int = 0) -> None:
        sums = found.setdefault(token, [1, 0, 0, 0, place, 0, 0])
        sums[1] += 1
        sums[5] += chars
        sums[6] += links

    for e in elements:
        add((e.path, ELEMENT, e.flags), e.place)
    for b in runs:
        add((b.path, _run_token(b), b.flags), b.place, len(b.text), b.links)
        add((b.path, RUNS, b.flags), b.place, len(b.text), b.links)
    mixed = {n: _number(f"{key}:{n}") for n in {sums[1] for sums in found.values()}}
    for sums in found.values():
        sums[2], sums[3] = mixed[sums[1]] >> 32 & 0xFFFFFFFF, mixed[sums[1]] & 0xFFFFFFFF
    return found


def tokens(pages: DataFrame, host: Column, page: Column) -> DataFrame:
    """The sums of all tokens of all pages by host; each task adds up its own first. Halves of 32 bits sum without overflow."""

    def count(batches):
        held: dict[tuple, list[int]] = {}

        def passed():
            keys = list(zip(*held, strict=True))
            sums = np.array(list(held.values()), np.int64).T
            columns = [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.int64()), pa.array(keys[3], pa.int32()), *map(pa.array, sums)]
            return pa.RecordBatch.from_arrays(columns, ["host", "path", "token", "flags", *_SUMS])

        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for token, sums in page_tokens(text or "", _number(text or "")).items():
                    before = held.get((h, *token))
                    held[(h, *token)] = sums if before is None else [a + b for a, b in zip(before, sums, strict=True)]
                if len(held) >= HELD:
                    yield passed()
                    held = {}
        if held:
            yield passed()

    with small_batches(pages.sparkSession):
        counted = pages.select(host.alias("host"), page.alias("page")).mapInArrow(count, _TOKENS)
        return stage(counted.groupBy("host", "path", "token", "flags").agg(*[F.sum(c).alias(c) for c in _SUMS]), "tokens")


def deduce(found: pd.DataFrame, support: float = SUPPORT) -> tuple[list[int], list[int], list[int]]:
    """(paths of slots, what each is, tokens of constant runs) from the tokens of one host that have support enough.

    ``found`` is bounded: tokens on a share of a host's pages are at most its mean number of tokens a page over that share.
    """
    total = int(found.loc[found.token == PAGE, "pages"].sum())
    members = found[(found.token != PAGE) & (found.token != RUNS) & (found.pages >= support * total)].copy()
    members["at"] = members.place / members.pages
    classes = []
    for vector, rows in members.groupby(["pages", "occurs", "high", "low"], sort=True):
        if len(rows) + (rows.token == ELEMENT).sum() > 1:
            classes.append((vector[0], len(rows), np.sort(rows["at"].to_numpy()), rows))
    classes.sort(key=lambda c: (-c[0], -c[1], c[2][0]))
    valid: list = []
    for c in classes:
        if all(_nested(c[2], v[2]) for v in valid):
            valid.append(c)
    if not valid:
        return [], [], []
    template = pd.concat([c[3] for c in valid]).sort_values("at")
    constant = template[(template.token != ELEMENT) & (template.pages >= CONSTANT * total)]
    kept = constant.groupby("path").chars.sum()
    sums = found[found.token == RUNS].groupby("path")[["chars", "links"]].sum()
    slots = template[template.token == ELEMENT]
    article = any(f & _ARTICLE and _live(f) for f in slots["flags"])

    def content(path: int, flags: int) -> int:
        if not _live(flags):
            return NO_CONTENT
        if article:
            return CONTENT if flags & _ARTICLE else NO_CONTENT
        chars, links = (int(sums.chars.get(path, 0)), int(sums.links.get(path, 0)))
        return UNDECIDED if not chars else CONTENT if 2 * (chars - int(kept.get(path, 0))) > chars and 2 * links < chars else NO_CONTENT

    return slots.path.tolist(), [content(p, f) for p, f in zip(slots["path"], slots["flags"], strict=True)], constant.token.tolist()


def _nested(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one of two sorted lists of places lies in one gap of the other, or before or after it."""
    inside = lambda x, y: np.searchsorted(y, x[0]) == np.searchsorted(y, x[-1], "right")
    return bool(inside(a, b) or inside(b, a))


def templates(counted: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """(host, slots, content, constant) of every host with pages enough."""
    # a host's count of pages is joined to its tokens of some pages only; a skewed join is split by the adaptive plan
    hosts = counted.where(F.col("token") == PAGE).where(F.col("pages") >= min_pages).select("host", F.col("pages").alias("of"))
    often = counted.where((F.col("pages") >= min_pages * support)).join(hosts, "host").where(F.col("pages") >= support * F.col("of"))

    def make(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        slots, content, constant = deduce(found, support)
        return pd.DataFrame({"host": [key[0]], "slots": [slots], "content": [content], "constant": [constant]})

    return often.groupBy("host").applyInPandas(make, "host string, slots array<long>, content array<int>, constant array<long>")


def main_text(page: str | None, slots: dict[int, int], constant: frozenset[int]) -> str:
    """The blocks of a page in its host's content slots, one a line; without any, by its own elements."""
    runs, elements = blocks(page or "")
    live = [b for b in runs if _live(b.flags)]
    deepest: dict[int, int | None] = {0: None}
    for e in elements:
        deepest[e.path] = e.path if slots.get(e.path, UNDECIDED) != UNDECIDED else deepest[e.parent]
    kind = lambda b: slots.get(deepest[b.path], UNDECIDED)
    fits = lambda b: _run_token(b) not in constant and (kind(b) == CONTENT or 2 * b.links < len(b.text))
    if any(b.flags & _ARTICLE for b in live):
        # articles that the template does not have count as much as those it has
        kept = [b for b in live if b.flags & _ARTICLE]
    else:
        kept = [b for b in live if kind(b) != NO_CONTENT and fits(b)] or [b for b in live if fits(b)] or live
    return "\n".join(b.text for b in kept)


@lru_cache(256)
def _template(slots: bytes, content: bytes, constant: bytes) -> tuple[dict[int, int], frozenset[int]]:
    return dict(zip(np.frombuffer(slots, np.int64).tolist(), np.frombuffer(content, np.int8).tolist(), strict=True)), frozenset(np.frombuffer(constant, np.int64).tolist())


@F.arrow_udf(T.StringType())
def _extracted(page: pa.Array, slots: pa.Array, content: pa.Array, constant: pa.Array) -> pa.Array:
    flat = lambda column, kind: [b"" if v is None else np.array(v, kind).tobytes() for v in column.to_pylist()]
    rows: Iterator = zip(page.to_pylist(), flat(slots, np.int64), flat(content, np.int8), flat(constant, np.int64), strict=True)
    return pa.array([main_text(p, *_template(s, c, k)) for p, s, c, k in rows], pa.string())


def extract(pages: DataFrame, url: str = "url", page: str = "html", name: str = "main_text", min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """Add ``name``, the main text, to every page; an existing column of that name is replaced, all others stay.

    ``pages`` is read twice: for the templates, then row by row. Hosts are the urls' in lower case; pages without one are
    a host of their own. Templates go to all executors while they are few, by their count; beyond BROADCAST numbers, pages
    meet them by host, large hosts in parts. A null, empty or blank page gives an empty text, equal rows give equal texts,
    no rows give none.
    """
    pages = pages.drop(name)
    host, slots, content, constant, part = fresh(pages, "host", "slots", "content", "constant", "part")
    of = F.lower(F.coalesce(F.regexp_extract(F.col(url), _HOST, 1), F.lit("")))
    counted = tokens(pages, of, F.col(page))
    found = stage(templates(counted, min_pages, support).select(F.col("host").alias(host), F.col("slots").alias(slots), F.col("content").alias(content), F.col("constant").alias(constant)), "templates")
    numbers = found.agg(F.sum(F.size(slots) + F.size(constant) + 8)).first()[0] or 0
    rows = pages.withColumn(host, of)
    if numbers <= BROADCAST:
        joined = rows.join(F.broadcast(found), host, "left")
    else:
        hot = counted.where((F.col("token") == PAGE) & (F.col("pages") > HOT)).select(F.col("host").alias(host), (F.col("pages") / HOT).cast("int").alias("parts"))
        hot = stage(hot, "hot")  # at most one host in HOT pages
        parts = F.coalesce(F.col("parts"), F.lit(0))
        rows = rows.join(F.broadcast(hot), host, "left").withColumn(part, F.pmod(F.xxhash64(page), parts + 1).cast("int")).drop("parts")
        spread = found.join(hot, host, "left").withColumn(part, F.explode(F.sequence(F.lit(0), parts))).drop("parts")
        joined = rows.join(spread, [host, part], "left").drop(part)
    discard(counted)
    return joined.withColumn(name, _extracted(F.col(page), slots, content, constant)).drop(host, slots, content, constant)


def op11_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
