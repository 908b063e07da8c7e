"""Declarations and identifier occurrences of source files, by one pass over each file's tokens.

A file is read once from left to right. Comments and strings are tokens of their own, whatever they hold; braces, or in Python
the indentation, open and close blocks on a stack, which gives ends, containers, depth and branches at once. Time is linear
in the text. What is found is an array in the file's row; resolving names to declarations is joins over these (code.py).
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as Y


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


@dataclass(frozen=True)
class Language:
    """How a language writes comments and strings, and the words that begin declarations."""

    skips: str
    modifiers: frozenset[str]
    kinds: frozenset[str]
    indented: bool = False
    methods: bool = False


_SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\.)*+"?', r"'(?:[^'\\\n]|\\.)*+'?"
_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,8})'"
_BLOCKS = r'"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\Z)'
_TICKS = r"`(?:[^`\\]|\\.)*+(?:`|\Z)"
_SCRIPT = rf"{_SLASHES}|{_TICKS}|{_DOUBLE}|{_SINGLE}"

#: Languages by name: modifiers and kinds from their grammars.
LANGUAGES = {
    "python": Language(r'#[^\n]*|[rRbBuUfF]{0,2}(?:"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\Z)' + r"|'''(?:[^'\\]|\\.|'(?!''))*+(?:'''|\Z)|" + rf"{_DOUBLE}|{_SINGLE})", _set("async"), _set("class def"), indented=True),
    "typescript": Language(_SCRIPT, _set("export default declare abstract async"), _set("class interface enum namespace type function const let var")),
    "javascript": Language(_SCRIPT, _set("export default async"), _set("class function const let var")),
    "go": Language(rf"{_SLASHES}|`[^`]*(?:`|\Z)|{_DOUBLE}|{_CHAR}", frozenset(), _set("func type const var")),
    "rust": Language(rf'{_SLASHES}|b?r(?P<hashes>#*)".*?(?:"(?P=hashes)|\Z)|"(?:[^"\\]|\\.)*+(?:"|\Z)|{_CHAR}', _set("pub default async unsafe extern"), _set("fn struct enum union trait impl mod type const static")),
    "java": Language(rf"{_SLASHES}|{_BLOCKS}|{_DOUBLE}|{_CHAR}", _set("public protected private static final abstract sealed strictfp"), _set("class interface enum record")),
    "kotlin": Language(rf"{_SLASHES}|{_BLOCKS}|{_DOUBLE}|{_CHAR}", _set("public internal protected private open final abstract sealed data inner value override suspend inline operator infix tailrec const lateinit companion"), _set("class interface object fun val var typealias")),
    "csharp": Language(rf'{_SLASHES}|\$*(?P<quotes>"""+).*?(?:(?P=quotes)|\Z)|(?:@\$?|\$@)"(?:[^"]|"")*+(?:"|\Z)|\$?{_DOUBLE}|{_CHAR}|(?:(?<=\n)|\A)[ \t]*#[^\n]*', _set("public internal protected private static virtual override abstract sealed async partial extern readonly ref file unsafe new"), _set("class interface struct enum record delegate namespace"), methods=True),
}
#: What a kind is called, where it is not its own word.
KINDS = {"def": "function", "fn": "function", "func": "function", "fun": "function", "const": "constant", "let": "constant", "var": "constant", "val": "constant", "static": "constant"}
#: Words and operators that add a way through a function, and statements that nest.
BRANCHES = _set("if for foreach while catch case when elif except and or && || ??  ?.")
NESTS = _set("if for foreach while do switch try using lock")
_ELSE = _set("elif else except finally")
_NO_METHOD = _set("return new else throw await using")
#: Words that are never a use of a name.
KEYWORDS = BRANCHES | NESTS | _ELSE | _NO_METHOD | _set("in is not as from import extends implements let with yield break continue pass self this base super null None true false True False var int long void string bool double float char byte object func function def class")
#: Lines after a declaration that a block may take to begin.
OPENS_WITHIN = 3
_DOC = re.compile(r"\s*(?:///?|#|\*|/\*\*?)\s*(.*?)\s*(?:\*/)?$")

_SYMBOL = Y.StructType([Y.StructField(n, Y.StringType()) for n in ("name", "kind", "container", "scope", "signature", "doc")] + [Y.StructField(n, Y.IntegerType()) for n in ("start_line", "start_column", "end_line", "complexity", "nesting")])
_USE = Y.StructType([Y.StructField(n, Y.StringType()) for n in ("name", "scope", "role", "qualifier")] + [Y.StructField(n, Y.IntegerType()) for n in ("line", "column")])
_ARROW = {"name": pa.string(), "kind": pa.string(), "container": pa.string(), "scope": pa.string(), "signature": pa.string(), "doc": pa.string(), "role": pa.string(), "qualifier": pa.string()}


@dataclass(slots=True)
class _Block:
    """An open block: its declaration or none, the depth that it adds, and what goes on after it."""

    symbol: dict | None
    weight: int
    indent: int = 0
    parens: int = 0
    waiting: int = 0
    early: list[dict] = field(default_factory=list)


@dataclass(slots=True)
class _Scan:
    """The state of a pass."""

    lines: list[str]
    symbols: list[dict] = field(default_factory=list)
    uses: list[dict] = field(default_factory=list)
    stack: list[_Block] = field(default_factory=list)
    holders: list[dict] = field(default_factory=list)
    pending: dict | None = None
    early: list[dict] = field(default_factory=list)
    branches: int = 0
    depth: int = 0

    def declare(self, name: str, kind: str, line: int, column: int) -> dict:
        if self.pending and self.pending["start_line"] < line:
            self.early.append(self.pending)  # a block that begins soon is taken for its own as well
            self.pending = None
        elif self.pending:
            self.end(self.pending, line)
        above = _DOC.fullmatch(self.lines[line - 2]) if line > 1 else None
        holder = self.holders[-1] if self.holders else None
        made = {
            "name": name, "kind": KINDS.get(kind, kind), "container": holder and holder["name"], "scope": self.inside(), "signature": self.lines[line - 1].strip(), "doc": (above and above[1]) or None,
            "start_line": line, "start_column": column, "end_line": line, "complexity": self.branches, "nesting": self.depth, "base": self.depth,
        }
        self.symbols.append(made)
        return made

    def inside(self) -> str:
        """The qualified name of the innermost declaration here."""
        of = self.pending or (self.holders[-1] if self.holders else None)
        return "" if of is None else f"{of['scope']}.{of['name']}" if of["scope"] else of["name"]

    def give_up(self) -> None:
        """No block has come: what waits for one ends on its line."""
        for symbol in [*self.early, *([self.pending] if self.pending else [])]:
            self.end(symbol, symbol["start_line"])
        self.early.clear()

    def deepen(self, to: int) -> None:
        for of in (self.pending, self.holders[-1] if self.holders else None):
            if of is not None and of["nesting"] < to:
                of["nesting"] = to

    def open(self, block: _Block) -> None:
        self.stack.append(block)
        self.depth += block.weight
        if block.symbol is not None:
            self.holders.append(block.symbol)
        elif block.weight:
            self.deepen(self.depth)

    def close(self, line: int) -> _Block:
        block = self.stack.pop()
        self.depth -= block.weight
        if block.symbol is not None:
            self.holders.pop()
            self.deepen(block.symbol["nesting"])
            self.end(block.symbol, line)
        for symbol in block.early:
            self.end(symbol, line)
        return block

    def end(self, symbol: dict, line: int) -> None:
        symbol["end_line"] = max(line, symbol["start_line"])
        symbol["complexity"] = 1 + self.branches - symbol["complexity"]
        symbol["nesting"] -= symbol.pop("base")
        if self.pending is symbol:
            self.pending = None


_TOKENS = {
    name: re.compile(rf"(?P<skip>{of.skips})|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<op>&&|\|\||\?\?=?|\?\.|=>|->|::|[{{}}()\[\];=.,<>:*?])", re.S)
    for name, of in LANGUAGES.items()
}


def scan(text: str, language: str) -> tuple[list[dict], list[dict]]:
    """(declarations, occurrences of other names) of a file; none in a language that is not known."""
    if language not in LANGUAGES:
        return [], []
    of, lines = LANGUAGES[language], re.split("\r?\n", text)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    run = _Scan(lines)
    step = _indented(run, of) if of.indented else _braced(run, of)
    next(step)
    for m in _TOKENS[language].finditer(text):
        line = bisect.bisect_right(starts, m.start())
        if m.lastgroup != "number":
            follows = text[m.end() : m.end() + 1]
            step.send((m.lastgroup if m["skip"] is None else "skip", m[0], line, m.start() - starts[line - 1] + 1, follows))
    step.send(("end", "", len(lines), 0, ""))
    for symbol in run.symbols:
        if "base" in symbol:  # never closed
            run.end(symbol, len(lines))
    return run.symbols, run.uses


def _counted(run: _Scan, kind: str, word: str, follows: str) -> None:
    if word in BRANCHES or (kind == "op" and word == "?" and follows.isspace()):
        run.branches += 1


def _used(run: _Scan, of: Language, before: list[str], word: str, line: int, column: int) -> None:
    """Note a word as a use of a name; ``before`` are the two tokens before it."""
    if word not in KEYWORDS and word not in of.kinds and word not in of.modifiers:
        dotted = before[1] in (".", "?.", "->", "::")
        run.uses.append({"name": word, "scope": run.inside(), "role": "new" if before[1] == "new" else "name", "qualifier": before[0] if dotted and (before[0][:1].isalpha() or before[0][:1] == "_") else None, "line": line, "column": column})


def _called(run: _Scan, line_of_last: tuple[int, int] | None) -> None:
    """The last use is called, if it is what stands right before the parenthesis."""
    if run.uses and line_of_last == (run.uses[-1]["line"], run.uses[-1]["column"]) and run.uses[-1]["role"] == "name":
        run.uses[-1]["role"] = "call"


def _indented(run: _Scan, of: Language):
    """Blocks by indentation: a line that stands no deeper than a block's first ends it on the line before; comments count as lines."""
    parens, at, naming, last, before = 0, 0, None, None, ["", ""]
    while True:
        kind, word, line, column, follows = yield
        if kind == "end":
            while run.stack:
                run.close(line)
            continue
        first = line != at and parens == 0
        at = line + word.count("\n")
        if first:
            naming = None
            while run.stack and run.stack[-1].indent >= column:
                run.close(line - 1)
        if kind == "skip":
            continue
        _counted(run, kind, word, follows)
        if word in ("(", "[", "{"):
            if word == "(":
                _called(run, last)
            parens += 1
        elif word in (")", "]", "}"):
            parens = max(parens - 1, 0)
        elif kind == "word":
            if naming:
                made = run.declare(word, naming[0], line, column)
                run.open(_Block(made, 0, naming[1]))
                naming = None
            elif first and word in of.modifiers:
                at = 0  # the word after it still begins the line
                indent = column
            elif (first or before[1] in of.modifiers) and word in of.kinds:
                naming = (word, column if before[1] not in of.modifiers or first and line != at else indent)
            else:
                if first and (word in NESTS or word in _ELSE):
                    run.open(_Block(None, 1, column))
                _used(run, of, before, word, line, column)
        last, before = (line, column), [before[1], word]


def _braced(run: _Scan, of: Language):
    """Blocks by braces. A declaration begins a statement; its block may begin some lines later, but not after a semicolon."""
    parens, at, waiting = 0, 0, 0
    begins, modified, kind_word, plain = True, 0, None, True
    last, before, near = None, ["", ""], 0
    candidate: tuple[str, int, int] | None = None
    generic: tuple[tuple[str, int, int] | None] | None = None  # what stands before an angle bracket
    skipping = 0  # parentheses before a name: a receiver, or arguments of a modifier or an attribute

    def started() -> tuple:
        return True, 0, None, True

    def named(of_kind: str) -> dict:
        """A declaration of the candidate; where that was noted as a use, it is one no more."""
        for i in range(len(run.uses) - 1, max(len(run.uses) - 9, -1), -1):
            if (run.uses[i]["line"], run.uses[i]["column"]) == candidate[1:]:
                del run.uses[i]
                break
        return run.declare(candidate[0], of_kind, candidate[1], candidate[2])

    while True:
        kind, word, line, column, follows = yield
        if kind == "end":
            run.give_up()
            while run.stack:
                run.close(line)
            continue
        if kind == "skip":
            continue
        if line != at and parens == 0 and skipping == 0:
            if kind_word is None:
                begins, modified, kind_word, plain = started()
                candidate = None
            if run.pending and line > near + OPENS_WITHIN:
                run.give_up()
        at = line
        _counted(run, kind, word, follows)
        if skipping:
            # arrows and comparisons are no brackets: they are other tokens, or do not stand here
            skipping += (word in ("(", "[", "<")) - (word in (")", "]", ">"))
        elif word == "{":
            if kind_word and candidate and parens == 0:
                run.pending = named(kind_word)
            holds = run.pending if parens == 0 else None
            run.open(_Block(holds, 0 if holds or parens else waiting, 0, parens, waiting if parens else 0))
            if holds:
                run.pending = None
                run.stack[-1].early = [x for x in run.early if line <= x["start_line"] + OPENS_WITHIN]
                run.early = [x for x in run.early if line > x["start_line"] + OPENS_WITHIN]
                run.give_up()
            parens, waiting = 0, 0
            begins, modified, kind_word, plain = started()
        elif word == "}":
            run.give_up()
            if run.stack:
                block = run.close(line)
                parens, waiting = block.parens, block.waiting
            begins, modified, kind_word, plain = started()
        elif word in ("(", "["):
            if kind_word and candidate:  # a name that its parameters follow
                run.pending, near = named(kind_word), line
                kind_word, begins, parens = None, False, parens + 1
            elif kind_word or word == "[" and begins and parens == 0 and not modified or word == "(" and begins and modified and candidate is None:
                skipping = 1
            else:
                _called(run, last)
                if word == "(" and parens == 0 and of.methods and modified and plain and candidate and not run.pending:
                    run.pending, near, begins, plain = named("method"), line, False, False
                parens += 1
        elif word in (")", "]"):
            parens = max(parens - 1, 0)
            near = line
        elif word == ";" and parens == 0:
            if kind_word and candidate:
                run.pending = named(kind_word)
            if run.pending:
                run.end(run.pending, line)
            run.give_up()
            waiting = 0
            begins, modified, kind_word, plain = started()
            candidate = None
        elif kind == "word":
            if begins and kind_word is None and word in of.modifiers and not (word == "new" and not modified):
                modified += 1
            elif (begins or modified and plain) and parens == 0 and word in of.kinds and (kind_word is None or word in of.kinds) and not (kind_word and kind_word in ("delegate", "fun")):
                kind_word, candidate, begins = (kind_word if kind_word == "record" else word), None, False
            elif kind_word and candidate is None and (word == "mut" or word in of.modifiers):
                kind_word, begins = (kind_word, begins) if word == "mut" else (None, True)
            elif kind_word:
                if candidate and before[1] == "." and kind_word == "namespace":
                    candidate = (f"{candidate[0]}.{word}", candidate[1], candidate[2])
                else:
                    if kind_word in ("delegate", "fun") and candidate:
                        _used(run, of, before, candidate[0], candidate[1], candidate[2])
                    candidate = (word, line, column)
                if kind_word not in ("delegate", "fun", "namespace"):
                    run.pending, near = named(kind_word), line
                    kind_word, begins = None, False
            else:
                if word in _NO_METHOD or before[1] == ".":
                    plain = plain and before[1] == "."
                begins = False
                candidate = (word, line, column)
                if word in NESTS:
                    waiting += 1
                    run.deepen(run.depth + waiting)
                _used(run, of, before, word, line, column)
        elif word in ("=", "=>") and not (kind_word and candidate is None):
            plain = begins = False
            if kind_word and candidate:
                run.pending, near, kind_word = named(kind_word), line, None
        elif kind_word and candidate is None and word in (":", "=", ".", ",", "?"):
            kind_word, begins, modified = None, False, 0  # a name like any other
        elif word == "<":
            if kind_word and candidate is None:
                skipping = 1  # parameters of a type before the name
            else:
                generic = (candidate,)
        elif word == ">":
            candidate, generic = generic[0] if generic else candidate, None
        elif word not in (",", ".", "?", "*", ":", "::"):
            begins = False
        last, before = (line, column), [before[1], word]


def _arrays(rows: list[list[dict]], kind: Y.StructType) -> pa.Array:
    fields = [(f.name, _ARROW.get(f.name, pa.int32())) for f in kind.fields]
    return pa.array([[{n: r[n] for n, _ in fields} for r in found] for found in rows], pa.list_(pa.struct(fields)))


@F.arrow_udf(Y.ArrayType(_SYMBOL))
def declarations(text: pa.Array, language: pa.Array) -> pa.Array:
    """The declarations of each file; a null text has none."""
    return _arrays([scan(t or "", n)[0] for t, n in zip(text.to_pylist(), language.to_pylist(), strict=True)], _SYMBOL)


@F.arrow_udf(Y.ArrayType(_USE))
def occurrences(text: pa.Array, language: pa.Array) -> pa.Array:
    """The occurrences of names in each file, those in declarations left out; a null text has none."""
    return _arrays([scan(t or "", n)[1] for t, n in zip(text.to_pylist(), language.to_pylist(), strict=True)], _USE)


@F.arrow_udf(Y.StructType([Y.StructField("declared", Y.ArrayType(_SYMBOL)), Y.StructField("used", Y.ArrayType(_USE))]))
def everything(text: pa.Array, language: pa.Array) -> pa.Array:
    """Both of each file, by one scan."""
    found = [scan(t or "", n) for t, n in zip(text.to_pylist(), language.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([_arrays([x[0] for x in found], _SYMBOL), _arrays([x[1] for x in found], _USE)], ["declared", "used"])
