"""Declarations, metrics and references of source code, from its tokens: no compiler runs here, so results approximate one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import tables
from . import scanner

def symbols(files: DataFrame, key: str = "path", text: str = "text", language: str = "language") -> DataFrame:
    """(key, name, kind, container, scope, signature, doc, start_line, start_column, end_line, complexity, nesting) of declarations.

    container is the innermost declaration whose block holds this one, scope the names of all of them, doc a comment right
    above. Each file is scanned once, in its row, in time linear in it.
    """
    known = files.where(F.col(language).isin(*scanner.LANGUAGES))
    return known.select(key, F.explode(scanner.declarations(F.col(text), F.col(language))).alias("s")).select(key, "s.*")


def metrics(files: DataFrame, key: str = "path", text: str = "text", language: str = "language") -> DataFrame:
    """(key, name, container, complexity, nesting, lines, start_line) of functions and methods."""
    found = symbols(files, key, text, language).where(F.col("kind").isin("function", "method"))
    return found.select(key, "name", "container", "complexity", "nesting", (F.col("end_line") - F.col("start_line") + 1).alias("lines"), "start_line")


def references(files: DataFrame, key: str = "path", text: str = "text", language: str = "language") -> DataFrame:
    """(path, line, column, name, role, scope, target_path, target, target_line, reach, candidates): where declared names are used,
    and the declaration of the same language that each use most likely means.

    reach tells how it was found: 0 by its qualifier, which is the type that declares it; 1 in the file, in a scope around the
    use, the innermost; 2 in the file; 3 in the folder; 4 elsewhere. Of ``candidates`` equals the first by path and line is
    named. Declarations are brought to one row a key before each join, so no use is multiplied, however frequent its name.
    """
    return references_of(scanned(files, key, text, language))


def scanned(files: DataFrame, key: str = "path", text: str = "text", language: str = "language") -> DataFrame:
    """(path, lang, s): what one scan of each file finds, declarations and uses, staged, for what needs both or either twice."""
    known = files.where(F.col(language).isin(*scanner.LANGUAGES))
    return tables.staged(known.select(F.col(key).alias("path"), F.col(language).alias("lang"), scanner.everything(F.col(text), F.col(language)).alias("s")), "scanned")


def symbols_of(known: DataFrame) -> DataFrame:
    """symbols() of scanned() files, by path."""
    return known.select("path", F.explode("s.declared").alias("s")).select("path", "s.*")


def references_of(known: DataFrame) -> DataFrame:
    """references() of scanned() files."""
    folder = F.regexp_extract("path", r"^(.*?)[^/]*$", 1)
    found = known.select("path", "lang", F.explode("s.declared").alias("s")).select("path", "lang", folder.alias("folder"), "s.name", "s.container", "s.scope", "s.start_line")
    found = tables.staged(found.withColumn("full", F.concat_ws(".", F.nullif("scope", F.lit("")), "name")), "declared")
    uses = known.select("path", "lang", F.explode("s.used").alias("u")).select("path", "lang", folder.alias("folder"), "u.*")
    uses = uses.join(found.select("lang", "name").distinct(), ["lang", "name"], "left_semi")

    def by(name: str, *keys: str) -> DataFrame:
        first = F.min(F.struct("path", "start_line", "full"))
        return found.where(F.col(keys[1]).isNotNull()).groupBy(*keys).agg(F.struct(first.alias("at"), F.count(F.lit(1)).alias("n")).alias(name))

    here = found.groupBy("path", "name").agg(F.collect_list(F.struct("scope", "start_line", "full")).alias("own"))  # one name's in one file
    rows = uses.join(here, ["path", "name"], "left")
    typed = by("typed", "lang", "container", "name").withColumnRenamed("container", "qualifier")
    rows = rows.join(typed, ["lang", "qualifier", "name"], "left").join(by("near", "lang", "folder", "name"), ["lang", "folder", "name"], "left").join(by("far", "lang", "name"), ["lang", "name"], "left")
    around = lambda d: (d["scope"] == "") | F.concat(F.col("scope"), F.lit(".")).startswith(F.concat(d["scope"], F.lit(".")))
    best = F.array_max(F.transform("own", lambda d: F.struct(around(d).alias("around"), F.when(around(d), F.length(d["scope"])).otherwise(0).alias("depth"), (-d["start_line"]).alias("up"), d["full"].alias("full"))))
    rows = rows.withColumn("best", best)
    other = lambda c: F.struct(F.col(f"{c}.at.path").alias("path"), F.col(f"{c}.at.full").alias("full"), F.col(f"{c}.at.start_line").alias("line"), F.col(f"{c}.n").alias("n"))
    mine = F.struct(F.col("path"), F.col("best.full").alias("full"), (-F.col("best.up")).alias("line"), F.lit(1).cast("long").alias("n"))
    reach = F.when(F.col("typed").isNotNull(), 0).when(F.col("best.around"), 1).when(F.col("best").isNotNull(), 2).when(F.col("near").isNotNull(), 3).otherwise(4)
    target = F.when(F.col("reach") == 0, other("typed")).when(F.col("reach") <= 2, mine).when(F.col("reach") == 3, other("near")).otherwise(other("far"))
    rows = rows.withColumn("reach", reach).withColumn("t", target)
    return rows.select("path", "line", "column", "name", "role", "scope", F.col("t.path").alias("target_path"), F.col("t.full").alias("target"), F.col("t.line").alias("target_line"), "reach", F.col("t.n").alias("candidates"))


def unused(found: DataFrame, used: DataFrame) -> DataFrame:
    """Symbols (path, full_name, start_line) that may be reported as unused and that no reference means."""
    meant = used.select(F.col("target_path").alias("path"), F.col("target_line").alias("start_line"), F.element_at(F.split("target", "[.]"), -1).alias("name")).distinct()
    return unused_candidates(found).join(meant, ["path", "start_line", "name"], "left_anti")


def calls(used: DataFrame) -> DataFrame:
    """(src, dst, path, line, column): calls inside declarations, as edges of a call graph, a row a site."""
    return used.where(F.col("role").isin("call", "new") & (F.col("scope") != "")).select(F.concat_ws(":", "path", "scope").alias("src"), F.concat_ws(":", "target_path", "target").alias("dst"), "path", "line", "column")


def metric_summary(rows: DataFrame) -> DataFrame:
    """(methods, average, most, over_10, over_20) of complexities."""
    c = F.col("complexity")
    return rows.agg(F.count(F.lit(1)).alias("methods"), F.bround(F.avg(c), 2).alias("average"), F.max(c).alias("most"), F.count_if(c > 10).alias("over_10"), F.count_if(c > 20).alias("over_20"))


def type_totals(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, lines, members, methods) of types, declarations of one name summed up, from symbols."""
    types = found.where(F.col("kind").isin("class", "struct", "record", "interface", "trait", "object")).groupBy(*by, "name").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    members = found.where("container is not null").groupBy(*by, F.col("container").alias("name")).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("kind").isin("function", "method")).alias("methods"))
    return types.join(members, [*by, "name"], "left").na.fill(0, ["members", "methods"])


def match_names(found: DataFrame, query: str, mode: str = "contains", kind: str | None = None, most: int = 50) -> DataFrame:
    """Symbols whose name, in any case, is the query, begins with it or holds it; the first declaration of each full name, by full name."""
    name, q = F.lower("name"), query.strip().lower()
    if mode not in ("exact", "prefix", "contains"):
        raise ValueError("exact, prefix or contains")
    hit = {"exact": name == q, "prefix": name.startswith(q), "contains": F.contains(name, F.lit(q))}[mode]
    rows = found.where(hit if kind is None else hit & (F.lower("kind") == kind.lower()))
    first = rows.withColumn("_p", F.row_number().over(Window.partitionBy("full_name").orderBy("path", "start_line"))).where("_p = 1").drop("_p")
    return first.orderBy("full_name").limit(most)


def get_symbol(found: DataFrame, name: str, most: int = 10) -> DataFrame:
    """Symbols of a full or simple name, those of the full name first."""
    rows = found.where((F.col("full_name") == name) | (F.col("name") == name))
    return rows.orderBy(F.col("full_name") != name, "full_name", "path", "start_line").limit(most)


def source_slice(text: Column, start: Column, end: Column, most: int = 201) -> Column:
    """The lines of a text from ``start`` to ``end``, from 1, at most ``most``."""
    return F.array_join(F.slice(F.split(text, "\r?\n", -1), start, F.least(end - start + 1, F.lit(most))), "\n")


def outline(found: DataFrame, path: str | None = None) -> DataFrame:
    """Symbols of a file, or of each file, in the order of its source, with ``place``."""
    rows = found if path is None else found.where(F.col("path") == path)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("start_line", "end_line", "name")))


def members(found: DataFrame, container: str) -> DataFrame:
    """What a type declares, in order."""
    return found.where(F.col("container") == container).orderBy("path", "start_line")


def in_scope(found: DataFrame, path: str, line: int, prefix: str = "") -> DataFrame:
    """Names that a line of a file can see, by how near they are: its own blocks, then the file, then others; first of a name."""
    here = (F.col("path") == path) & (F.col("start_line") <= line) & (F.col("end_line") >= line)
    rank = F.when(here, 0).when(F.col("path") == path, 1).otherwise(2)
    rows = found.where(F.lower("name").startswith(prefix.lower())).withColumn("reach", rank)
    once = rows.groupBy("name").agg(F.min(F.struct("reach", "path", "start_line", "kind")).alias("s"))
    return once.select("name", "s.*").orderBy("reach", "name")


def resolve(found: DataFrame, name: str) -> str:
    """The one full name that a name stands for: itself, else the one that ends in it, else in any case; several are an error."""
    last = lambda c: (c == name) | c.endswith("." + name)
    hits = (F.col("full_name") == name, last(F.col("full_name")), (F.lower("full_name") == name.lower()) | F.lower("full_name").endswith("." + name.lower()))
    way = F.coalesce(*[F.when(hit, i) for i, hit in enumerate(hits)])
    rows = found.select(way.alias("way"), "full_name").where("way is not null").distinct().orderBy("way", "full_name").limit(6).collect()  # one pass
    names = [r["full_name"] for r in rows if r["way"] == rows[0]["way"]]
    if len(names) == 1:
        return names[0]
    if names:
        raise LookupError(f"{name!r} is ambiguous: {', '.join(names)}")
    raise LookupError(f"There is no {name!r}.")


def unused_candidates(found: DataFrame) -> DataFrame:
    """Symbols that may be reported as unused: declared names but for entry points, tests, overrides, and members of interfaces."""
    entry = F.lower("name").isin("main", "configure", "dispose", "tostring", "equals", "gethashcode", "__init__", "setup", "teardown")
    test = F.regexp_like(F.coalesce("path", F.lit("")), F.lit(r"(?i)(^|/)tests?(/|$)")) | F.lower("name").startswith("test")
    marked = F.regexp_like("signature", F.lit(r"\b(?:override|abstract|extern|partial)\b|@Override|\[(?:Fact|Test|Theory)"))
    return found.where(~entry & ~test & ~marked & ~F.col("kind").isin("namespace", "mod", "impl"))
