import random
import time

import pytest

from strata.operators import code, scanner


def found(text, language):
    return [(s["name"], s["kind"], s["container"], s["start_line"], s["end_line"], s["complexity"], s["nesting"]) for s in scanner.scan(text, language)[0]]


def used(text, language):
    return [(u["name"], u["role"], u["qualifier"], u["scope"], u["line"], u["column"]) for u in scanner.scan(text, language)[1]]


CSHARP = '''#if DEBUG {
// note i { Part1.M1() }
namespace Shop.Parts {
  public class Part3 { private string s = "} Part1.M1( {"; /* { */
    [Fact(Skip = "x{")] public int M1(int a) { return a; } public int N1(int a)
    {
      var t = @"say ""{"" "; var r = """ { "" """; char c = '{';
      if (a > 1 && a < 9) { while (a > 0) { a--; } }
      return M1(a) + Part7.M1(a);
    }
    public static Part3 Make<T>(T x) => new Part3();
    public delegate int Handler(int a);
  }
  public record struct Pt(int X);
}'''


def test_csharp():
    assert found(CSHARP, "csharp") == [
        ("Shop.Parts", "namespace", None, 3, 15, 4, 2), ("Part3", "class", "Shop.Parts", 4, 13, 4, 2), ("M1", "method", "Part3", 5, 5, 1, 0), ("N1", "method", "Part3", 5, 10, 4, 2),
        ("Make", "method", "Part3", 11, 11, 1, 0), ("Handler", "delegate", "Part3", 12, 12, 1, 0), ("Pt", "record", "Shop.Parts", 14, 14, 1, 0),
    ]
    calls = [u for u in used(CSHARP, "csharp") if u[1] in ("call", "new")]
    assert calls == [("M1", "call", None, "Shop.Parts.Part3.N1", 9, 14), ("M1", "call", "Part7", "Shop.Parts.Part3.N1", 9, 28), ("Part3", "new", None, "Shop.Parts.Part3.Make", 11, 45)]


def test_python():
    text = 'class A:\n    """\ndef no(): pass\n"""\n    async def b(self,\n  x=1):\n        for i in x:\n            if i and self.b(i):\n                pass\n        else:\n            A.b("def q(): (")\n    y = [i for i in range(3) if i]\n# c\ndef z(): return A()'
    assert found(text, "python") == [("A", "class", None, 1, 12, 6, 2), ("b", "function", "A", 5, 11, 4, 2), ("z", "function", None, 14, 14, 1, 0)]
    assert [(n, q, s) for n, r, q, s, *_ in used(text, "python") if r == "call"] == [("b", "self", "A.b"), ("b", "A", "A.b"), ("range", None, "A"), ("A", None, "z")]


@pytest.mark.parametrize(("language", "text", "want"), [
    ("rust", "pub(crate) fn a<'x>(s: &'x str) -> u8 { let r = r#\"{ \" \"#; if s == \"x\" { 1 } else { 2 } }\nimpl<T> Foo<T> for Bar { fn b(&self) {} }\nconst unsafe fn q() {}\nstatic mut Z: u8 = 1;",
     [("a", "function", None, 1, 1), ("Foo", "impl", None, 2, 2), ("b", "function", "Foo", 2, 2), ("q", "function", None, 3, 3), ("Z", "constant", None, 4, 4)]),
    ("go", "type P struct {\n}\nfunc (p *P) Run() {\n  s := `}\n}`\n}\nfunc Plain(a int) (int, error) {\n}", [("P", "type", None, 1, 2), ("Run", "function", None, 3, 6), ("Plain", "function", None, 7, 8)]),
    ("typescript", "export default class A<T> extends B {\n}\nfunction* gen() { yield `}${a}` }\nexport type X = { a: string };\nlet q = {type: 1, b: {}}", [("A", "class", None, 1, 2), ("gen", "function", None, 3, 3), ("X", "type", None, 4, 4), ("q", "constant", None, 5, 5)]),
    ("java", 'public final class A { String s = """\n } " { """; enum E { X } }', [("A", "class", None, 1, 2), ("E", "enum", "A", 2, 2)]),
    ("kotlin", "object O { val z = 1\n fun <T> A.name(x: T): Int = 3\n}", [("O", "object", None, 1, 3), ("z", "constant", "O", 1, 1), ("name", "function", "O", 2, 2)]),
    ("cobol", "fn a() {}", []), ("python", "", []), ("csharp", "}}}} ) ] ; {", []), ("csharp", 'class A { string s = "never closed', [("A", "class", None, 1, 1)]),
])
def test_languages(language, text, want):
    assert [f[:5] for f in found(text, language)] == want


@pytest.mark.parametrize("language", sorted(scanner.LANGUAGES))
def test_any_text_in_linear_time(language):
    rng = random.Random(1)
    pieces = ["{", "}", "(", ")", '"', "'", '"""', "`", "/*", "*/", "//", "#", "\n", " ", "class ", "def ", "fn ", "if ", "a", "(", ";", "=", "<", ">", "@\"", "r#\"", "\\", "é", "public ", "new "]
    for _ in range(60):
        scanner.scan("".join(rng.choices(pieces, k=200)), language)
    for text in ("{" * 60000, "(" * 60000, '"' * 60000, "class A {\n" * 20000, "def a():\n " * 20000, "/*" * 60000, "public int a(int b) { if (b) { return 1; } }\n" * 20000, "'" * 60000, "a<" * 40000):
        began = time.perf_counter()
        scanner.scan(text, language)
        assert time.perf_counter() - began < 20


def test_references(spark):
    files = [
        ("a/x.py", "python", "class Box:\n    def put(self, n):\n        return self.put(n) + size(n)\n\ndef size(n):\n    return n\n"),
        ("a/y.py", "python", "from x import Box, size\n\ndef use():\n    b = Box()\n    Box.put(b)\n    return size(b) + 'size(1)'  # size\n"),
        ("b/z.py", "python", "def size(q):\n    return 0\n\ndef far():\n    return Box() and size(1)\n"),
        ("b/w.go", "go", "func size() {\n}\nfunc put() { size() }\n"), ("c/e.py", "python", None),
    ]
    used = code.references(spark.createDataFrame(files, "path string, language string, text string"))
    got = {(r["path"], r["line"], r["column"]): (r["target_path"], r["target"], r["target_line"], r["reach"], r["candidates"]) for r in used.collect()}
    assert got == {
        ("a/x.py", 3, 21): ("a/x.py", "Box.put", 2, 1, 1), ("a/x.py", 3, 30): ("a/x.py", "size", 5, 1, 1), ("a/y.py", 1, 15): ("a/x.py", "Box", 1, 3, 1), ("a/y.py", 1, 20): ("a/x.py", "size", 5, 3, 1),
        ("a/y.py", 4, 9): ("a/x.py", "Box", 1, 3, 1), ("a/y.py", 5, 5): ("a/x.py", "Box", 1, 3, 1), ("a/y.py", 5, 9): ("a/x.py", "Box.put", 2, 0, 1), ("a/y.py", 6, 12): ("a/x.py", "size", 5, 3, 1),
        ("b/z.py", 5, 12): ("a/x.py", "Box", 1, 4, 1), ("b/z.py", 5, 22): ("b/z.py", "size", 1, 1, 1), ("b/w.go", 3, 14): ("b/w.go", "size", 1, 1, 1),
    }
    edges = {(r["src"], r["dst"]) for r in code.calls(used).collect()}
    assert ("a/y.py:use", "a/x.py:Box.put") in edges and ("b/z.py:far", "b/z.py:size") in edges and len(edges) == 8
