"""Queries over references in source code. Each part is a file whose layout follows its numbers, with names in strings and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import code, graph
from ..sources import tables
from .registry import query

#: Parts of a file: k its number, q that of another one, i a method's, {and} and {if}, {fi} something i times.
_HEAD = {"csharp": 'namespace Shop.Parts {\n  public class Part{k} { private string s = "} Part1.M1( {"; /* { */', "python": 'class Part{k}:\n    """Doc Part1.M1(\n    def no(self): class X:"""'}
_METHOD = {
    "csharp": '    public int M{i}(int a) { return a; } public int N{i}(int a)\n    {\n      var t = @"say ""{"" ";\n      {if}a--;{fi}\n      return M{i}(a) + Part{q}.M1(a);\n    }',
    "python": "    def M{i}(self, a):\n        if a > 1{and}:\n            while a:\n                a -= 1\n        return self.M{i}(a) + Part{q}.M1(a)\n",
}
_TAIL = {"csharp": "  }\n}", "python": "# Part1.M1()"}
_NOTE = {"csharp": "// note { Part1.M1()\n", "python": "# note Part1.M1( {\n"}


def _files(spark, sf_dir) -> DataFrame:
    part = tables.dealt(tables.load(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(F.col("p_partkey").alias("k"), (2 * F.col("p_size") + F.col("p_partkey") % 2).alias("q"))
    s = lambda c: F.col(c).cast("string")

    def text(language: str):
        put = lambda t: F.replace(F.replace(F.lit(t), F.lit("{k}"), s("k")), F.lit("{q}"), s("q"))
        again = lambda t, i: F.repeat(F.lit(t), i)

        def method(i):
            one = F.replace(put(_METHOD[language]), F.lit("{i}"), i.cast("string"))
            for mark, t in (("{and}", " and a"), ("{if}", "if (a > 1) { "), ("{fi}", " }")):
                one = F.replace(one, F.lit(mark), again(t, i))
            return one

        methods = F.transform(F.sequence(F.lit(1), (F.col("k") % 4 + 1).cast("int")), method)
        return F.concat(again(_NOTE[language], (F.col("k") % 3).cast("int")), put(_HEAD[language]), F.lit("\n"), F.array_join(methods, "\n"), F.lit("\n" + _TAIL[language]))

    even = F.col("k") % 2 == 0
    return part.select(F.concat(F.lit("src/d"), (F.col("k") % 5).cast("string"), F.lit("/p"), s("k")).alias("path"), F.when(even, "csharp").otherwise("python").alias("language"), F.when(even, text("csharp")).otherwise(text("python")).alias("text"))


# Where things stand: by number k, method i and the first line l of it.
_LAYOUT = """p AS (SELECT p_partkey AS k, 2 * p_size + p_partkey % 2 AS q, p_partkey % 3 + CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 4 END AS l0, 'src/d' || p_partkey % 5 || '/p' || p_partkey AS path,
 CASE WHEN p_partkey % 2 = 0 THEN 'Shop.Parts.' ELSE '' END || 'Part' || p_partkey AS qname FROM part),
m AS (SELECT *, unnest(range(1, k % 4 + 2)) AS i FROM p), n AS (SELECT *, l0 + (i - 1) * 6 AS l, CASE WHEN k % 2 = 0 THEN 14 ELSE 21 END AS col, qname || CASE WHEN k % 2 = 0 THEN '.N' ELSE '.M' END || i AS scope FROM m),
u AS (SELECT path, l + 4 AS line, col AS "column", 'M' || i AS name, 'call' AS role, scope, path AS target_path, qname || '.M' || i AS target, l AS target_line, 1 AS reach FROM n
UNION ALL SELECT n.path, l + 4, col + 8, 'Part' || n.q, 'name', scope, t.path, t.qname, t.k % 3 + 1 + (t.k + 1) % 2, CASE WHEN n.k = t.k THEN 1 WHEN n.k % 5 = t.k % 5 THEN 3 ELSE 4 END FROM n JOIN p t ON t.k = n.q
UNION ALL SELECT n.path, l + 4, col + 13 + length(n.q::VARCHAR), 'M1', 'call', scope, t.path, t.qname || '.M1', t.l0, 0 FROM n JOIN p t ON t.k = n.q),
d AS (SELECT path, 'Part' || k AS name, k % 3 + 1 + (k + 1) % 2 AS line FROM p UNION ALL SELECT path, 'M' || i, l FROM n UNION ALL SELECT path, 'N' || i, l FROM n WHERE k % 2 = 0),
e AS (SELECT path || ':' || scope AS src, target_path || ':' || target AS dst FROM u WHERE role = 'call')"""


@query(f"WITH {_LAYOUT} SELECT path, line, \"column\", name, role, scope, target_path, target, target_line, reach, 1 AS candidates FROM u")
def code_references(spark, sf_dir):
    """Every use of a declared name with the declaration that it means."""
    return code.references(_files(spark, sf_dir))


@query(f"WITH {_LAYOUT} SELECT path, name, line FROM d WHERE NOT EXISTS (SELECT 1 FROM u WHERE target_path = d.path AND target_line = d.line AND u.name = d.name)")
def code_unused(spark, sf_dir):
    """Declarations that nothing refers to."""
    known = code.scanned(_files(spark, sf_dir))
    found = code.symbols_of(known).withColumn("full_name", F.concat_ws(".", F.nullif("scope", F.lit("")), "name"))
    return code.unused(found, code.references_of(known)).select("path", "name", F.col("start_line").alias("line"))


@query(f"WITH {_LAYOUT} SELECT src, dst, count(*) AS n FROM e GROUP BY ALL")
def code_calls(spark, sf_dir):
    """Calls between methods, by pair."""
    return graph.edge_counts(code.calls(code.references(_files(spark, sf_dir))))


@query(f"""WITH {_LAYOUT}, s AS (SELECT path || ':' || qname || '.M1' AS node FROM p WHERE k = 3), o1 AS (SELECT DISTINCT dst AS node FROM e JOIN s ON src = s.node WHERE dst <> s.node), o2 AS (SELECT DISTINCT dst AS node FROM e JOIN o1 ON src = o1.node EXCEPT (SELECT node FROM o1 UNION SELECT node FROM s)),
i1 AS (SELECT DISTINCT src AS node FROM e JOIN s ON dst = s.node WHERE src <> s.node), i2 AS (SELECT DISTINCT src AS node FROM e JOIN i1 ON dst = i1.node EXCEPT (SELECT node FROM i1 UNION SELECT node FROM s))
SELECT node, 'start' AS direction, 0 AS level FROM s UNION ALL SELECT node, 'out', 1 FROM o1 UNION ALL SELECT node, 'out', 2 FROM o2 UNION ALL SELECT node, 'in', 1 FROM i1 UNION ALL SELECT node, 'in', 2 FROM i2""")
def code_call_graph(spark, sf_dir):
    """What a method calls and what calls it, two steps each way, from calls found in the files."""
    edges = tables.staged(code.calls(code.references(_files(spark, sf_dir))).select("src", "dst"), "calls")
    nodes, _ = graph.call_graph(edges, spark.createDataFrame([("src/d3/p3:Part3.M1",)], "node string"), 2, most=1 << 30)
    return nodes


@query(f"WITH {_LAYOUT} SELECT path, 'M' || i AS name, CASE WHEN k % 2 = 0 THEN 1 ELSE 3 + i END::INT AS complexity, CASE WHEN k % 2 = 0 THEN 0 ELSE 2 END AS nesting FROM n UNION ALL SELECT path, 'N' || i, (1 + i)::INT, i::INT FROM n WHERE k % 2 = 0")
def code_metrics_varied(spark, sf_dir):
    """Complexity and nesting of methods whose layout differs from file to file."""
    return code.metrics(_files(spark, sf_dir)).select("path", "name", "complexity", "nesting")
