"""Files as rows: scans with ignore rules, languages, listings, text heads and tails, manifests, reports, commit logs."""

from __future__ import annotations

import datetime as dt
import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import glob_regex
from . import tables

MOST_BYTES, MOST_MEDIA_BYTES, TREE_MOST = 512 << 10, 25 << 20, 5000

# Folders and files that are never indexed, languages by file name and extension, media types.
EXCLUDED_FOLDERS = (
    ".git", ".hg", ".svn", "bin", "obj", "node_modules", ".vs", ".idea", ".vscode", "dist", "build", "out", "target", "packages", "TestResults", ".next", ".nuxt", ".cache",
    ".terraform", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "coverage", ".gradle", ".dart_tool", "Pods", "DerivedData", "vendor",
)
SECRET_FILES = (
    ".env", ".env.*", "*.pem", "*.pfx", "*.p12", "*.key", "*.jks", "*.keystore", "id_rsa", "id_rsa.*", "id_ed25519", "id_ed25519.*", "*.crt", "*.cer", "*.der", "secrets.json",
    "*.secrets.json", ".npmrc", ".pypirc", ".netrc", "*.kdbx", "*.tfstate", "*.tfstate.*", "credentials", "credentials.json",
)
NOISE_FILES = (
    "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "*.snap", "*.dll", "*.exe", "*.pdb", "*.so", "*.dylib", "*.nupkg", "*.zip",
    "*.gz", "*.tar", "*.7z", "*.rar", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.svg", "*.webp", "*.bmp", "*.pdf", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.mp3", "*.mp4",
    "*.mov", "*.wav", "*.db", "*.sqlite", "*.sqlite3", "*.bin", "*.dat", "*.class", "*.jar", "*.pyc", "*.o", "*.a", "*.lib", "*.obj", "*.wasm",
)
LANGUAGES = {
    ".cs": "csharp", ".csx": "csharp", ".razor": "razor", ".cshtml": "razor", ".fs": "fsharp", ".fsx": "fsharp", ".vb": "vb", ".csproj": "msbuild", ".fsproj": "msbuild",
    ".vbproj": "msbuild", ".props": "msbuild", ".targets": "msbuild", ".slnx": "msbuild", ".sln": "sln", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript",
    ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".rb": "ruby", ".go": "go", ".rs": "rust",
    ".java": "java", ".kt": "kotlin", ".swift": "swift", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".sql": "sql", ".sh": "shell",
    ".bash": "shell", ".zsh": "shell", ".ps1": "powershell", ".psm1": "powershell", ".bat": "batch", ".cmd": "batch", ".md": "markdown", ".mdx": "markdown",
    ".markdown": "markdown", ".rst": "text", ".txt": "text", ".adoc": "text", ".json": "json", ".jsonc": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml",
    ".config": "xml", ".ini": "ini", ".editorconfig": "ini", ".html": "html", ".htm": "html", ".css": "css", ".scss": "css", ".less": "css", ".vue": "vue", ".svelte": "svelte",
    ".graphql": "graphql", ".proto": "protobuf", ".tf": "terraform", ".dockerfile": "dockerfile", ".gradle": "gradle", ".cmake": "cmake", ".mk": "makefile",
}
NAMES = {
    "dockerfile": "dockerfile", "makefile": "makefile", "cmakelists.txt": "cmake", "jenkinsfile": "groovy", "license": "text", "readme": "text", ".gitignore": "ini",
    ".gitattributes": "ini",
}
MEDIA_TYPES = {
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp", ".svg": "image/svg+xml",
    ".ico": "image/x-icon", ".mp3": "audio/mpeg", ".wav": "audio/wav", ".ogg": "audio/ogg", ".flac": "audio/flac", ".mp4": "video/mp4", ".webm": "video/webm",
    ".pdf": "application/pdf", ".json": "application/json", ".xml": "application/xml", ".zip": "application/zip", ".txt": "text/plain", ".md": "text/markdown",
    ".html": "text/html", ".css": "text/css", ".js": "text/javascript", ".csv": "text/csv",
}


def _named(globs: tuple[str, ...]) -> str:
    """A regular expression over paths whose last part matches one of the globs."""
    return "(?i)(?:^|/)(?:" + "|".join(re.escape(g).replace(r"\*", "[^/]*") for g in globs) + ")$"


def ignored(path: Column, user: tuple[str, ...] = ()) -> Column:
    """Whether a relative path is left out: an excluded folder, a secret or noise file, or a user's rule.

    User rules are lines of an ignore file: # comments, "!" exceptions, a leading or inner "/" anchors, a
    trailing "/" means folders only.
    """
    folder = F.regexp_like(path, F.lit("(?i)(?:^|/)(?:" + "|".join(map(re.escape, EXCLUDED_FOLDERS)) + ")/"))
    out = folder | F.regexp_like(path, F.lit(_named(SECRET_FILES))) | F.regexp_like(path, F.lit(_named(NOISE_FILES)))

    def matches(rules: list[str]) -> Column:
        hit = F.lit(False)
        for rule in rules:
            body = rule.strip("/")
            prefix = "" if "/" in rule.rstrip("/") else "**/"
            hit = hit | F.regexp_like(path, F.lit(glob_regex(f"{prefix}{body}/**")))
            if not rule.endswith("/"):
                hit = hit | F.regexp_like(path, F.lit(glob_regex(prefix + body if "/" in prefix + body else f"./{body}").replace(r"(?i)^\./", "(?i)^")))
        return hit

    rules = [r.strip() for r in user if r.strip() and not r.startswith("#")]
    return out | (matches([r for r in rules if r[0] != "!"]) & ~matches([r[1:] for r in rules if r[0] == "!"]))


def language(path: Column) -> Column:
    """The language by file name, then by extension, else text."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    extension = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return F.coalesce(F.element_at(table(NAMES), name), F.element_at(table(LANGUAGES), extension), F.lit("text"))


def media_type(path: Column) -> Column:
    """The media type by extension, else application/octet-stream."""
    extension = F.regexp_extract(F.lower(path), r"(\.[^./]*)$", 1)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), extension), F.lit("application/octet-stream"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 without its byte order mark, or UTF-16 where a mark says so; what is invalid is replaced."""
    head = F.hex(F.substring(content, 1, 3))
    utf8 = F.make_valid_utf8(F.decode(content, "UTF-8"))
    return F.when(head == "EFBBBF", F.substring(utf8, F.lit(2), F.length(utf8))).when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16")).otherwise(utf8)


def is_binary(content: Column) -> Column:
    """Whether the first 8000 bytes hold a NUL."""
    return F.regexp_like(F.hex(F.substring(content, 1, 8000)), F.lit("^(?:..)*?00"))


def scan(spark: SparkSession, root: str, user: tuple[str, ...] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, size, modified, language, content_hash, text) of the text files below ``root`` that no rule leaves out.

    Listing and reading are distributed; sizes are filtered before contents are read.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "file:" + root if root.startswith("/") else root
    path = F.ltrim(F.regexp_replace(F.col("path"), "^" + re.escape(base).replace("file:", "(?:file:)?(?://)?"), ""), F.lit("/"))
    rows = rows.where(F.col("length") <= most_bytes).withColumn("rel", path).where(~ignored(F.col("rel"), user)).where(~is_binary(F.col("content")))
    return rows.select(F.col("rel").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), language(F.col("rel")).alias("language"), F.md5("content").alias("content_hash"), decoded(F.col("content")).alias("text"))


def head_tail(text: Column, head: int | None = None, tail: int | None = None) -> Column:
    """The first or the last lines of a text; both at once are an error."""
    if head is not None and tail is not None:
        raise ValueError("Give head or tail, not both.")
    lines = F.split(text, "\r?\n", -1)
    if head is not None:
        return F.array_join(F.slice(lines, 1, head), "\n")
    if tail is not None:
        return F.array_join(F.slice(lines, F.greatest(F.size(lines) - tail, F.lit(0)) + 1, tail), "\n") if tail else F.lit("")
    return text


def tree(paths: DataFrame, path: str = "path", depth: int | None = None, most: int = TREE_MOST) -> DataFrame:
    """(entry, level, kind, n_files, truncated): folders and files of paths, each once, in order, at most ``most``; whether there were more."""
    parts = F.split(path, "/")
    rows = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("entry"), i.alias("level"), F.when(i == F.size(parts), "file").otherwise("dir").alias("kind")))).alias("e")).select("e.*")
    if depth is not None:
        rows = rows.where(F.col("level") <= depth)
    return rows.groupBy("entry", "level", "kind").agg(F.count(F.lit(1)).alias("n_files")).transform(lambda found: capped(found.orderBy("entry", "kind"), most))


def capped(df: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, each with ``truncated``: whether there was another. Only most + 1 rows are looked at."""
    some = df.limit(most + 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return some.withColumn("truncated", F.col("_n") > most).drop("_n").limit(most)


def search_files(paths: DataFrame, pattern: str, exclude: tuple[str, ...] = (), path: str = "path") -> DataFrame:
    """Paths that match a glob and none of the excluded ones, in order; catalog.page gives pages of them."""
    hit = F.regexp_like(F.col(path), F.lit(glob_regex(pattern)))
    for e in exclude:
        hit = hit & ~F.regexp_like(F.col(path), F.lit(glob_regex(e)))
    return paths.where(hit).orderBy(path)


class Guard:
    """Lets through paths below allowed folders, with links resolved; relative ones are below the first."""

    def __init__(self, folders: list[str]):
        if not folders:
            raise ValueError("Allow at least one folder.")
        self.folders = [os.path.realpath(f) for f in folders]
        if missing := [f for f in self.folders if not os.path.isdir(f)]:
            raise ValueError(f"Not a folder: {missing[0]}")

    def resolve(self, path: str) -> str:
        """The real path, if it is allowed; links out of the allowed folders are not followed."""
        real = os.path.realpath(os.path.join(self.folders[0], os.path.expanduser(path)))
        if not any(os.path.commonpath([real, f]) == f for f in self.folders):
            raise PermissionError(f"Outside the allowed folders: {path}")
        return real

    def listing(self, spark: SparkSession) -> DataFrame:
        """(folder) that are allowed."""
        return spark.createDataFrame([(f,) for f in self.folders], "folder string")


_ENTRIES = "name string, kind string, size long, modified timestamp"


def list_directory(spark: SparkSession, folder: str, by: str = "name") -> DataFrame:
    """(name, kind, size, modified, place) of a folder's entries: folders first by name, or by size, largest first."""
    rows = [(n, "dir" if d else "file", None if d else size, dt.datetime.fromtimestamp(ms / 1000, dt.UTC)) for n, d, size, ms in tables.listing(spark, folder)]
    order = {"name": [F.col("kind") != "dir", F.col("name")], "size": [F.col("size").desc_nulls_last(), F.col("name")]}[by]
    return spark.createDataFrame(rows, _ENTRIES).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def folder_totals(entries: DataFrame) -> DataFrame:
    """(n_files, n_dirs, bytes) of what list_directory gives."""
    return entries.agg(F.count_if(F.col("kind") == "file").alias("n_files"), F.count_if(F.col("kind") == "dir").alias("n_dirs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, size, modified, media_type, language) of one file or folder."""
    folder, _, name = path.rstrip("/").rpartition("/")
    rows = [(path, "dir" if d else "file", None if d else size, dt.datetime.fromtimestamp(ms / 1000, dt.UTC)) for n, d, size, ms in tables.listing(spark, folder or "/") if n == name]
    if not rows:
        raise FileNotFoundError(path)
    found = spark.createDataFrame(rows, _ENTRIES.replace("name", "path"))
    return found.withColumn("media_type", media_type(F.col("path"))).withColumn("language", language(F.col("path")))


def read_media(spark: SparkSession, paths: str | list[str], most_bytes: int = MOST_MEDIA_BYTES) -> DataFrame:
    """(path, media_type, size, data, error) of media files: contents in base 64, or an error for those that are too large."""
    rows = spark.read.format("binaryFile").load(paths)
    fits = F.col("length") <= most_bytes
    return rows.select("path", media_type(F.col("path")).alias("media_type"), F.col("length").alias("size"), F.when(fits, F.translate(F.base64("content"), "\r\n", "")).alias("data"), F.when(~fits, "too large").alias("error"))


def requested(files: DataFrame, wanted: list[str]) -> DataFrame:
    """(path, text, error) of each requested path, found or not."""
    ask = files.sparkSession.createDataFrame([(p,) for p in wanted], "path string")
    return ask.join(files.select("path", "text"), "path", "left").withColumn("error", F.when(F.col("text").isNull(), "not found"))


def _git(root: str, *args: str) -> str:
    """What git prints; it runs on the driver, as the repository is there."""
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60, check=True).stdout


def git_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of tracked files and of untracked ones that git does not ignore, in order."""
    found = _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split("\0")
    return spark.createDataFrame([(p,) for p in sorted(set(found) - {""})], "path string")


def git_changes(spark: SparkSession, root: str) -> DataFrame:
    """(path) of files that differ from the last commit; a rename gives both names."""
    fields = _git(root, "status", "--porcelain", "-z", "--untracked-files=all").split("\0")
    found: set[str] = set()
    at = 0
    while at < len(fields) and fields[at]:
        found.add(fields[at][3:])
        if fields[at][0] in "RC":
            at += 1
            found.add(fields[at])
        at += 1
    return spark.createDataFrame([(p,) for p in sorted(found)], "path string")


def git_head(root: str) -> str:
    """The commit that is checked out."""
    return _git(root, "rev-parse", "HEAD").strip()


def git_log(spark: SparkSession, root: str, most: int = 800) -> DataFrame:
    """(commit_no, files) of the latest commits without merges."""
    out = _git(root, "log", "--no-merges", f"-{most}", "--name-only", "--format=%x01")
    rows = [(i, [f for f in block.split("\n") if f]) for i, block in enumerate(out.split("\x01")[1:])]
    return spark.createDataFrame(rows, "commit_no int, files array<string>")


def scan_repository(spark: SparkSession, root: str, user: tuple[str, ...] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """scan(), of the files that git lists where ``root`` is a repository."""
    found = scan(spark, root, user, most_bytes)
    return found.join(git_files(spark, root), "path", "left_semi") if os.path.isdir(os.path.join(root, ".git")) else found


def build_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """(file, line, severity, code, message) of compiler output, distinct, in order."""
    shape = r"^\s*(.+?)\((\d+)(?:,\d+)?\):\s+(error|warning)\s+(\w+):\s+(.*?)(?:\s+\[[^\]]*\])?$"
    rows = texts.select(F.explode(F.split(text, "\r?\n")).alias("l")).where(F.regexp_like("l", F.lit(shape)))
    get = lambda i: F.regexp_extract("l", shape, i)
    return rows.select(get(1).alias("file"), get(2).cast("int").alias("line"), get(3).alias("severity"), get(4).alias("code"), get(5).alias("message")).distinct().orderBy("file", "line", "code", "message")


def test_reports(spark: SparkSession, path: str, row: str = "UnitTestResult") -> DataFrame:
    """(name, outcome, seconds) of XML test reports; durations are hours:minutes:seconds there."""
    schema = "_testName string, _outcome string, _duration string"
    rows = spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    part = lambda i: F.element_at(F.split("_duration", ":"), i).cast("double")
    return rows.select(F.col("_testName").alias("name"), F.col("_outcome").alias("outcome"), (part(1) * 3600 + part(2) * 60 + part(3)).alias("seconds"))


def report_totals(reports: DataFrame) -> DataFrame:
    """(total, passed, failed, skipped, seconds) of test_reports' rows."""
    was = lambda *o: F.count_if(F.lower("outcome").isin(*o))
    return reports.agg(F.count(F.lit(1)).alias("total"), was("passed").alias("passed"), was("failed", "error", "timeout").alias("failed"), was("notexecuted", "skipped").alias("skipped"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 3).alias("seconds"))


def packages(spark: SparkSession, path: str, kind: str = "PackageReference") -> DataFrame:
    """(project, package, version) that XML project files declare; PackageVersion as ``kind`` reads central ones."""
    texts = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("project"), "value")
    return declared_packages(texts, kind)


def declared_packages(texts: DataFrame, kind: str = "PackageReference") -> DataFrame:
    """(project, package, version) of project files given as (project, value); a version may be an attribute or an element."""
    found = F.regexp_extract_all("value", F.lit(rf'(?s)<{kind}\s[^>]*?Include="[^"]+"[^>]*?(?:/>|>.*?</{kind}>)'), F.lit(0))
    rows = texts.select("project", F.explode(found).alias("x"))
    version = F.coalesce(F.nullif(F.regexp_extract("x", r'\bVersion="([^"]+)"', 1), F.lit("")), F.nullif(F.trim(F.regexp_extract("x", r"(?s)<Version>(.*?)</Version>", 1)), F.lit("")))
    return rows.select("project", F.regexp_extract("x", r'Include="([^"]+)"', 1).alias("package"), version.alias("version"))


def package_versions(declared: DataFrame, central: DataFrame, resolved: DataFrame) -> DataFrame:
    """(project, package, declared, central, resolved, kind): declared packages with what a central file and the resolver say.

    Declared ones without a version take the central one; resolved packages that a project does not declare are its
    transitive ones. Names match in any case.
    """
    key = lambda df, name: df.select(*[c for c in ("project",) if c in df.columns], F.lower("package").alias("k"), F.col("package").alias(f"{name}_p"), F.col("version").alias(name))
    d, c, r = key(declared, "declared"), key(central, "central").drop("central_p"), key(resolved, "resolved")
    met = d.join(c, "k", "left").join(r, ["project", "k"], "full")
    return met.select("project", F.coalesce("declared_p", "resolved_p").alias("package"), F.coalesce("declared", "central").alias("declared"), "central", "resolved", F.when(F.col("declared_p").isNull(), "transitive").otherwise("direct").alias("kind"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON registry (id, title, summary, enabled, baseUrl, maxChars): ids given and unique, addresses given, maxChars from 1 to 200000."""
    schema = "servers array<struct<id:string,title:string,summary:string,enabled:boolean,baseUrl:string,maxChars:int>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.inline("servers"))
    return checked_registry(rows)


def checked_registry(rows: DataFrame) -> DataFrame:
    """``rows`` of a registry, if each is valid; else an error that names the first faults."""
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("id is not null and n > 1").select("id", F.lit("id is not unique").alias("fault"))
    fault = F.when(F.trim(F.coalesce("id", F.lit(""))) == "", "id is missing").when(~F.coalesce(F.col("baseUrl").rlike("^https?://"), F.lit(False)), "baseUrl is no address").when(~F.coalesce("maxChars", F.lit(1)).between(1, 200_000), "maxChars is out of range")
    faults = rows.select("id", fault.alias("fault")).where("fault is not null").unionByName(repeated).limit(5).collect()
    if faults:
        raise ValueError("; ".join(f"{r['id']}: {r['fault']}" for r in faults))
    return rows
