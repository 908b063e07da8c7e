"""Queries over source code, project files and edits, made of the parts table so that each row has a text of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import edits
from ..functions import text as T
from ..operators import code, gateway, indexing
from ..sources import files, tables
from .registry import query, redact_sql

#: A text for each language, {} is the part's number and %s its size; what it declares: name, kind, container, first and last line.
_SOURCES: dict[str, tuple[str, tuple[tuple, ...]]] = {
    "python": (
        "# about part {}\nclass Part{}:\n    def size(self):\n        if self.n > %s:\n            return %s\n        return 0\n\nasync def make_{}(a):\n    while a and not a.b or a.c:\n        a = a.d",
        (("Part{}", "class", None, 2, 7), ("size", "function", "Part{}", 3, 7), ("make_{}", "function", None, 8, 10)),
    ),
    "typescript": (
        "export class Part{} {\n  n = %s;\n}\n\nexport const MAX_{} = %s;\n\nexport async function load{}(a) {\n  if (a && a.b || %s > 3) {\n    for (const x of a) {\n      run(x);\n    }\n  }\n  return a ? 1 : 2;\n}",
        (("Part{}", "class", None, 1, 3), ("MAX_{}", "constant", None, 5, 5), ("load{}", "function", None, 7, 14)),
    ),
    "csharp": (
        "namespace Parts{};\n\n/// A part of size %s.\npublic sealed partial class Part{}\n{\n    public override int Size(int a)\n    {\n        if (a > 1) // if not {\n        {\n            while (a > %s)\n            {\n                a--;\n            }\n        }\n        return a ?? 0;\n    }\n}",
        (("Parts{}", "namespace", None, 1, 1), ("Part{}", "class", None, 4, 17), ("Size", "method", "Part{}", 6, 16)),
    ),
    "go": (
        "type Part{} struct {\n\tN int\n}\n\nfunc (p *Part{}) Run{}() {\n\tif p.N > %s {\n\t\treturn\n\t}\n}",
        (("Part{}", "type", None, 1, 3), ("Run{}", "function", None, 5, 9)),
    ),
}
#: Branches and depth of the functions, by name.
_METRICS = {"size": (2, 1), "make_{}": (4, 1), "load{}": (6, 2), "Size": (4, 2), "Run{}": (2, 1)}


def _sources(spark, sf_dir) -> DataFrame:
    """(path, language, text): a source file for each part."""
    part = tables.dealt(tables.load(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    no = (F.col("p_partkey") % len(_SOURCES) + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), no)
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.replace(F.replace(pick([t for t, _ in _SOURCES.values()]), F.lit("{}"), k), F.lit("%s"), n)
    return part.select(F.concat(F.lit("src/p"), k).alias("path"), pick(list(_SOURCES)).alias("language"), text.alias("text"))


def _quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"


_ROWS = ", ".join(f"({i}, {', '.join(map(_quoted, row))}, {', '.join(map(_quoted, _METRICS.get(row[0], (None, None))))})" for i, (_, rows) in enumerate(_SOURCES.values()) for row in rows)
_FOUND = f"""t(lang, name, kind, container, first, last, c, d) AS (VALUES {_ROWS}),
s AS (SELECT 'src/p' || p_partkey AS path, replace(name, '{{}}', p_partkey::VARCHAR) AS name, kind, replace(container, '{{}}', p_partkey::VARCHAR) AS container, first::INT AS start_line, last::INT AS end_line, c::INT AS complexity, d::INT AS nesting, lang FROM part JOIN t ON p_partkey % 4 = lang),
g AS (SELECT *, CASE WHEN container IS NULL THEN name ELSE container || '.' || name END AS full_name FROM s)"""


def _symbols(spark, sf_dir) -> DataFrame:
    found = code.symbols(_sources(spark, sf_dir))
    return found.withColumn("full_name", F.concat_ws(".", "container", "name"))


@query(f"WITH {_FOUND} SELECT path, name, kind, container, start_line, end_line FROM s")
def code_symbols(spark, sf_dir):
    return _symbols(spark, sf_dir).select("path", "name", "kind", "container", "start_line", "end_line")


@query(f"WITH {_FOUND} SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY start_line, end_line, name)::INT AS place FROM s")
def file_outline(spark, sf_dir):
    return code.outline(_symbols(spark, sf_dir)).select("path", "name", "place")


@query(f"WITH {_FOUND} SELECT path, name, container, complexity, nesting, end_line - start_line + 1 AS lines, start_line FROM s WHERE kind IN ('function', 'method')")
def complexity_metrics(spark, sf_dir):
    return code.metrics(_sources(spark, sf_dir))


@query(f"WITH {_FOUND} SELECT count(*) AS methods, round_even(avg(complexity), 2) AS average, max(complexity) AS most, count(*) FILTER (complexity > 10) AS over_10, count(*) FILTER (complexity > 20) AS over_20 FROM s WHERE kind IN ('function', 'method')")
def complexity_summary(spark, sf_dir):
    return code.metric_summary(code.metrics(_sources(spark, sf_dir)))


@query(f"""WITH {_FOUND}, m AS (SELECT path, container AS name, count(*) AS members, count(*) FILTER (kind IN ('function', 'method')) AS methods FROM s WHERE container IS NOT NULL GROUP BY ALL)
SELECT s.path, s.name, sum(end_line - start_line + 1)::BIGINT AS lines, coalesce(max(members), 0) AS members, coalesce(max(methods), 0) AS methods FROM s LEFT JOIN m USING (path, name) WHERE kind = 'class' GROUP BY ALL""")
def type_totals(spark, sf_dir):
    return code.type_totals(_symbols(spark, sf_dir), ["path"])


@query(f"WITH {_FOUND}, f AS (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY path, start_line) AS p FROM g WHERE contains(lower(name), 'part1')) SELECT path, full_name, kind FROM f WHERE p = 1 ORDER BY full_name LIMIT 50")
def symbols_contain(spark, sf_dir):
    return code.match_names(_symbols(spark, sf_dir), "PART1").select("path", "full_name", "kind")


@query(f"WITH {_FOUND}, f AS (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY path, start_line) AS p FROM g WHERE lower(name) = 'size' AND kind = 'method') SELECT path, full_name, kind FROM f WHERE p = 1 ORDER BY full_name LIMIT 50")
def symbols_exact_kind(spark, sf_dir):
    return code.match_names(_symbols(spark, sf_dir), "size", "exact", "Method").select("path", "full_name", "kind")


@query(f"WITH {_FOUND} SELECT path, full_name FROM g WHERE full_name = 'size' OR name = 'size' ORDER BY full_name <> 'size', full_name, path, start_line LIMIT 10")
def get_symbol(spark, sf_dir):
    return code.get_symbol(_symbols(spark, sf_dir), "size").select("path", "full_name")


@query("SELECT 'src/p' || p_partkey AS path, '    def size(self):' || chr(10) || '        if self.n > ' || p_size || ':' AS source FROM part WHERE p_partkey % 4 = 0")
def symbol_source(spark, sf_dir):
    """The first two lines of a method, cut out of its file."""
    found = _symbols(spark, sf_dir).where("name = 'size'").join(_sources(spark, sf_dir).where("language = 'python'"), "path")
    return found.select("path", code.source_slice(F.col("text"), F.col("start_line"), F.col("end_line"), 2).alias("source"))


@query(f"WITH {_FOUND} SELECT path, name, start_line FROM s WHERE container = 'Part2'")
def type_members(spark, sf_dir):
    return code.members(_symbols(spark, sf_dir), "Part2").select("path", "name", "start_line")


@query(f"""WITH {_FOUND}, r AS (SELECT name, CASE WHEN path = 'src/p0' AND start_line <= 4 AND end_line >= 4 THEN 0 WHEN path = 'src/p0' THEN 1 ELSE 2 END AS reach, path, start_line, kind FROM s WHERE starts_with(lower(name), 'part'))
SELECT name, reach, path, start_line, kind FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY reach, path, start_line, kind) = 1""")
def symbols_in_scope(spark, sf_dir):
    return code.in_scope(_symbols(spark, sf_dir), "src/p0", 4, "Part")


@query(f"WITH {_FOUND} SELECT path, name FROM s WHERE kind <> 'namespace' AND NOT (name = 'Size' AND kind = 'method') AND NOT (kind = 'class' AND lang = 2)")
def unused_candidates(spark, sf_dir):
    return code.unused_candidates(_symbols(spark, sf_dir)).select("path", "name")


@query("SELECT 'Part2.Size' AS name")
def name_resolution(spark, sf_dir):
    return spark.createDataFrame([(code.resolve(_symbols(spark, sf_dir), "part2.size"),)], "name string")


# --- Markdown, project files, edits ------------------------------------------------------------------------------


@query("""WITH t AS (SELECT p_partkey, unnest([{'title': 'Part ' || p_partkey, 'full_name': 'Part ' || p_partkey, 'level': 1, 'start_line': 1, 'end_line': 4}, {'title': p_name, 'full_name': 'Part ' || p_partkey || ' > ' || p_name, 'level': 2, 'start_line': 5, 'end_line': 10},
{'title': p_type, 'full_name': 'Part ' || p_partkey || ' > ' || p_name || ' > ' || p_type, 'level': 4, 'start_line': 11, 'end_line': 12}, {'title': p_brand, 'full_name': 'Part ' || p_partkey || ' > ' || p_brand, 'level': 2, 'start_line': 13, 'end_line': 15}]) AS h FROM part)
SELECT p_partkey, h.title AS title, h.full_name AS full_name, h.level::INT AS level, h.start_line::INT AS start_line, h.end_line::INT AS end_line FROM t""")
def markdown_headings(spark, sf_dir):
    part = tables.load(spark, sf_dir, "part")
    text = F.concat(F.lit("# Part "), F.col("p_partkey").cast("string"), F.lit("\n\nIntro.\n\n## "), F.col("p_name"), F.lit(" ##\n\n```\n# no heading\n```\n\n#### "), F.col("p_type"), F.lit("\ntext\n## "), F.col("p_brand"), F.lit("\n\nLast."))
    return indexing.headings(part.select("p_partkey", text.alias("text")), "p_partkey")


@query("""WITH d AS (SELECT 'p' || l_orderkey || '.proj' AS project, 'Lib' || l_partkey AS package, CASE WHEN min(l_linenumber) % 2 = 0 THEN min(l_linenumber) || '.0' END AS version FROM lineitem GROUP BY ALL),
c AS (SELECT lower('Lib' || p_partkey) AS k, p_size || '.5' AS central FROM part),
r AS (SELECT 'p' || o_orderkey || '.proj' AS project, 'lib' || (o_orderkey % 50) AS package, '9.9' AS resolved FROM orders)
SELECT coalesce(x.project, r.project) AS project, coalesce(x.package, r.package) AS package, x.declared, x.central, r.resolved, CASE WHEN x.package IS NULL THEN 'transitive' ELSE 'direct' END AS kind
FROM (SELECT project, package, coalesce(version, central) AS declared, central FROM d LEFT JOIN c ON lower(d.package) = k) x FULL JOIN r ON x.project = r.project AND lower(x.package) = lower(r.package)""")
def package_versions(spark, sf_dir):
    """Project files made of orders: declared packages, central versions and what was resolved."""
    li = tables.load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n"))
    version = F.when(F.col("n") % 2 == 0, F.when(F.col("n") % 4 == 0, F.concat(F.lit(' Version="'), F.col("n").cast("string"), F.lit('.0" />'))).otherwise(F.concat(F.lit(">\n<Version>"), F.col("n").cast("string"), F.lit(".0</Version></PackageReference>")))).otherwise(F.lit(" />"))
    line = F.concat(F.lit('<PackageReference Include="Lib'), F.col("l_partkey").cast("string"), F.lit('"'), version)
    texts = li.groupBy("l_orderkey").agg(F.concat(F.lit("<Project>\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n</Project>")).alias("value"))
    declared = files.declared_packages(texts.select(F.concat(F.lit("p"), F.col("l_orderkey").cast("string"), F.lit(".proj")).alias("project"), "value"))
    central = tables.load(spark, sf_dir, "part").select(F.concat(F.lit("lib"), F.col("p_partkey").cast("string")).alias("package"), F.concat(F.col("p_size").cast("string"), F.lit(".5")).alias("version"))
    resolved = tables.load(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string"), F.lit(".proj")).alias("project"), F.concat(F.lit("lib"), (F.col("o_orderkey") % 50).cast("string")).alias("package"), F.lit("9.9").alias("version"))
    return files.package_versions(declared, central, resolved)


@query("SELECT doc_id, md5('BEGIN' || chr(10) || left(text, instr(text, 'a') - 1) || '_' || substr(text, instr(text, 'a') + 1)) AS digest FROM documents WHERE instr(text, 'a') > 0")
def edit_fold(spark, sf_dir):
    """Two edits in order: the first is found with other blanks than it is written with, the second at its first place; texts without a place are left out."""
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("begin  edit\n"), F.col("text")).alias("text"))
    edited = docs.select("doc_id", edits.apply_edits(F.col("text"), [("begin edit", "BEGIN"), ("a", "_")]).alias("text"))
    return edited.where("text is not null").select("doc_id", F.md5("text").alias("digest"))


@query()
def text_diff(spark, sf_dir):
    """What redaction and a line at the end change in each document, as a unified diff."""
    docs = tables.load(spark, sf_dir, "documents")
    after = F.concat(T.redact(F.col("text")), F.lit("\nend."))
    return docs.select("doc_id", edits.diffs(F.col("text"), after).alias("diff"))


@query(f"""WITH r AS (SELECT doc_id, string_split_regex(text, '\r?\n') AS a, string_split_regex({redact_sql('text')} || chr(10) || 'end.', '\r?\n') AS b FROM documents)
SELECT doc_id, (len(list_filter(b, lambda x, i: i > len(a) OR x <> a[i])))::BIGINT AS added FROM r WHERE len(b) = len(a) + 1""".replace("\\r", "\r"))
def text_diff_added(spark, sf_dir):
    """Lines that the diffs of text_diff add, where redaction takes no line away."""
    docs = tables.load(spark, sf_dir, "documents").where(F.size(F.split("text", "\r?\n", -1)) == F.size(F.split(T.redact(F.col("text")), "\r?\n", -1)))
    added = F.size(F.filter(F.split("diff", "\n"), lambda x: x.startswith("+") & ~x.startswith("+++ b/")))
    return text_diff(spark, sf_dir).join(docs.select("doc_id"), "doc_id").select("doc_id", added.cast("long").alias("added"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '\.html$') THEN 'text/html' ELSE 'application/octet-stream' END AS media_type FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)")
def media_types(spark, sf_dir):
    return tables.load(spark, sf_dir, "pages").select("page_id", files.media_type(F.regexp_replace("url", r"[?#].*$", "")).alias("media_type"))


@query("SELECT doc_id, trim(replace(replace(text, chr(13), ''), chr(10), ' ')) AS line, trim(replace(split_part(text, chr(10), 1), chr(13), '')) AS first FROM documents")
def one_line(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents").select("doc_id", T.one_line(F.col("text")).alias("line"), T.first_line(F.col("text")).alias("first"))


@query(r"SELECT doc_id, array_to_string(list_slice(list_distinct_in_order, 1, 400), ' ') AS words FROM (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_in_order FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: length(x) >= 3 AND regexp_matches(x, '[A-Z_]')) AS w FROM documents))")
def identifier_words(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents").select("doc_id", F.array_join(T.identifier_words(F.col("text")), " ").alias("words"))


@query("SELECT count(*) AS total, count(*) FILTER (event_type <> 'error' AND event_type <> 'view') AS passed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS skipped, round(sum(value), 3) AS seconds FROM events")
def report_totals(spark, sf_dir):
    was = F.when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "view", "NotExecuted").otherwise("Passed")
    return files.report_totals(tables.load(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("name"), was.alias("outcome"), F.col("value").alias("seconds")))


@query()
def list_directory(spark, sf_dir):
    return files.list_directory(spark, sf_dir, "size").select("name", "kind", "size", "place")


@query("SELECT 14::BIGINT AS n")
def directory_tables(spark, sf_dir):
    """Tables that the folder's listing shows."""
    return files.list_directory(spark, sf_dir).where(F.col("name").endswith(".parquet")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 's' || s_suppkey AS server, 't' || p.n AS tool, CASE WHEN s_suppkey % 7 = 0 THEN 'unreachable' END AS error FROM supplier, (SELECT unnest([0, 1]) AS n) p WHERE s_nationkey <> 3 AND (s_suppkey % 7 <> 0 OR p.n = 0)".replace("'t' || p.n AS tool", "CASE WHEN s_suppkey % 7 <> 0 THEN 't' || p.n END AS tool"))
def discover_tools(spark, sf_dir):
    """Tools of each enabled server of a registry; a server that does not answer is a row with its error."""
    s = tables.load(spark, sf_dir, "supplier")
    servers = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_nationkey") != 3).alias("enabled"))
    tools = F.array(*[F.struct(F.lit(f"t{i}").alias("tool"), F.lit("{}").alias("schema")) for i in range(2)])
    answers = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_suppkey") % 7 != 0, tools).alias("tools"), F.when(F.col("s_suppkey") % 7 == 0, "unreachable").alias("error"))
    return gateway.discover_tools(servers, answers).select("server", "tool", "error")


@query("SELECT doc_id, text_size > 500 AS cut, least(text_size, 500) AS shown FROM (SELECT doc_id, length(text) AS text_size FROM documents)")
def tool_result_cut(spark, sf_dir):
    rows = gateway.cut_results(tables.load(spark, sf_dir, "documents"), "text", 500)
    return rows.select("doc_id", "cut", F.length("text").alias("shown"))
