"""Repository intake: a directory or ZIP of sources as a table of files, classified, hashed, rooted, counted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.globs import glob_regex
from plumbline.operators.fusion import greedy

from .archives import contents, directory

#: Languages by extension, names and extensions that tell a kind.
LANGUAGES = {
    "java": "JAVA", "ts": "TYPESCRIPT", "tsx": "TYPESCRIPT", "js": "JAVASCRIPT", "jsx": "JAVASCRIPT", "py": "PYTHON", "json": "JSON",
    "yaml": "YAML", "yml": "YAML", "xml": "XML", "toml": "TOML", "sh": "SHELL", "md": "MARKDOWN",
}
PROGRAMS, DATA = ("JAVA", "TYPESCRIPT", "JAVASCRIPT", "PYTHON"), ("JSON", "YAML", "XML", "TOML", "SHELL")
BINARY = ("png", "jpg", "jpeg", "gif", "webp", "ico", "pdf", "zip", "jar", "class", "exe", "dll", "so", "dylib", "bin", "woff", "woff2", "ttf", "mp4", "mp3")
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml")
MANIFESTS = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "package.json", "Dockerfile", "docker-compose.yml", "docker-compose.yaml")
CONFIG = (".gitignore", ".gitattributes", ".env", ".env.example", "Makefile")
DOCS = ("README", "LICENSE", "NOTICE")
GENERATED_DIRS, GENERATED_ENDS = ("dist", "build", "target", "generated"), (".min.js", ".min.css", ".generated.ts", ".generated.js", ".generated.java")
TEST_DIRS = ("test", "tests", "__tests__")
#: Directories that are left out by default.
DEFAULT_EXCLUDES = (".git", "node_modules", "target", "dist", "build", ".idea", "coverage")
#: Bytes at the start of a file in which a NUL makes it binary.
PREFIX_BYTES = 8_192


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, content) of all files below root, paths relative to it. Reads in parallel from any file system."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://", 1)[-1].lstrip("/")
    rel = F.regexp_replace("path", f"^.*?{base.replace('.', chr(92) + '.')}/", "")
    return files.select(rel.alias("path"), F.col("length").alias("size_bytes"), "content")


def scan_zip(spark: SparkSession, path: str, max_entries: int = 100_000, max_bytes: int = 1 << 30) -> DataFrame:
    """(archive, path, size_bytes, content, problem) of the entries of ZIP files. Unsafe paths, entries that differ only in
    case, archives over the limits, and what cannot be unpacked give a row with a problem and no content. See archives.directory()
    for the same without contents."""
    return contents(directory(spark, path, max_entries, max_bytes))


def _ignored(path: Column, lines: Sequence[str], before: Column) -> Column:
    """`before`, or what the last line that matches says: true, or false if it begins with !."""
    last = before
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        keep, glob = line.startswith("!"), line.lstrip("!").rstrip("/")
        only_inside = line.endswith("/")  # a directory: what is in it
        glob = glob.lstrip("/") if "/" in glob else f"**/{glob}"
        hit = path.rlike(glob_regex(f"{glob}/**/*"))
        last = F.when(hit if only_inside else hit | path.rlike(glob_regex(glob)), not keep).otherwise(last)
    return last


def excluded_by(path: Column, custom: Sequence[str] = (), ignore: Sequence[str] | Mapping[str, Sequence[str]] = ()) -> Column:
    """DEFAULT, CUSTOM or GITIGNORE, or null: asked in this order. `ignore` has the lines of the root's ignore file, or those of each
    directory that has one ("" is the root); a file is asked of those above it, from the root down, by its path from there. The last
    line that matches wins, and one that begins with ! takes a path back."""
    default = F.exists(F.split(path, "/"), lambda s: s.isin(*DEFAULT_EXCLUDES))
    mine = F.lit(False)
    for glob in custom:
        mine = mine | path.rlike(glob_regex(glob))
    scopes = dict(ignore) if isinstance(ignore, Mapping) else {"": ignore}
    last = F.lit(False)
    for directory in sorted(scopes, key=lambda d: (d.count("/") + (d != ""), d)):
        if directory:
            own = _ignored(F.substring(path, len(directory) + 2, 1 << 20), scopes[directory], last)
            last = F.when(path.startswith(f"{directory}/"), own).otherwise(last)
        else:
            last = _ignored(path, scopes[directory], last)
    return F.when(default, "DEFAULT").when(mine, "CUSTOM").when(last, "GITIGNORE")


def classified(files: DataFrame, path: str = "path", content: str | None = None) -> DataFrame:
    """files with extension, language, kind (first that fits of BINARY, LOCKFILE, MANIFEST, GENERATED, TEST, SOURCE,
    CONFIG, DOCUMENTATION, OTHER) and analysis_eligible. If a column of contents is named, a file with a NUL in its first bytes is
    binary whatever its name; by the path alone, such a source stays one and extraction reports it."""
    p = F.col(path)
    name = F.regexp_extract(p, "([^/]*)$", 1)
    dirs = F.split(F.regexp_replace(p, "[^/]*$", ""), "/")
    ext = F.lower(F.regexp_extract(name, r"[^.]\.([A-Za-z0-9]+)$", 1))
    language = F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)
    language = F.when(name == "Dockerfile", "DOCKERFILE").otherwise(language)
    binary = ext.isin(*BINARY)
    if content:
        binary = binary | F.coalesce(F.instr(F.decode(F.substring(content, 1, PREFIX_BYTES), "ISO-8859-1"), "\0") > 0, F.lit(False))
    generated = F.exists(dirs, lambda d: d.isin(*GENERATED_DIRS))
    for end in GENERATED_ENDS:
        generated = generated | name.endswith(end)
    test = F.exists(dirs, lambda d: F.lower(d).isin(*TEST_DIRS)) | name.contains(".test.") | name.contains(".spec.") | name.endswith("Test.java")
    kind = (
        F.when(binary, "BINARY")
        .when(name.isin(*LOCKFILES), "LOCKFILE")
        .when(name.isin(*MANIFESTS), "MANIFEST")
        .when(generated, "GENERATED")
        .when(language.isin(*PROGRAMS) & test, "TEST")
        .when(language.isin(*PROGRAMS), "SOURCE")
        .when(language.isin(*DATA) | name.isin(*CONFIG), "CONFIG")
        .when((language == "MARKDOWN") | name.isin(*DOCS), "DOCUMENTATION")
        .otherwise("OTHER")
    )
    out = files.withColumns({"extension": ext, "language": language, "kind": kind})
    return out.withColumn("analysis_eligible", F.coalesce(F.col("kind").isin("SOURCE", "TEST") & F.col("language").isin("JAVA", "TYPESCRIPT", "JAVASCRIPT"), F.lit(False)))


def hash_budget(files: DataFrame, group: str, limit: int = 8 << 20, budget: int = 256 << 20) -> DataFrame:
    """(group, path, hash_status): HASHED, BINARY, TOO_LARGE, or BUDGET where a file no longer fits what is left in path
    order; smaller files after it may still fit, so this is a fold over each snapshot's slim rows."""
    out = F.when(F.col("kind") == "BINARY", "BINARY").when(F.col("size_bytes") > limit, "TOO_LARGE")
    rows = files.select(group, "path", out.alias("_out"), F.when(out.isNull(), F.col("size_bytes")).alias("_size"))
    status = F.coalesce("_out", F.when(F.col("fits"), "HASHED").otherwise("BUDGET"))
    return greedy(rows, group, ["path"], "_size", budget).select(group, "path", status.alias("hash_status"))


def source_roots(files: DataFrame) -> DataFrame:
    """(root, is_test, languages, files) of eligible files."""
    own = files.filter("analysis_eligible")
    root = F.regexp_extract("path", r"^((?:.*/)?src/(?:main|test)/[a-z]+|(?:.*/)?(?:src|test|tests|__tests__|spec))/", 1)
    rows = own.select(root.alias("root"), (F.col("kind") == "TEST").alias("is_test"), "language")
    return rows.groupBy("root", "is_test").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.count(F.lit(1)).alias("files"))


def statistics(files: DataFrame) -> DataFrame:
    """Counts by kind, by language and in total."""
    rows = files.groupingSets([["kind"], ["language"], []], "kind", "language").agg(F.count(F.lit(1)).alias("files"), F.grouping_id().alias("_g"))
    dim = F.when(F.col("_g") == 1, "kind").when(F.col("_g") == 2, "language").otherwise("total")
    return rows.select(dim.alias("dimension"), F.when(F.col("_g") == 3, "*").otherwise(F.coalesce("kind", "language", F.lit("none"))).alias("value"), "files")


def write_json(df: DataFrame, path: str) -> None:
    """A JSON-lines sink with doubles rounded to twelve places and columns in name order."""
    doubles = {c for c, t in df.dtypes if t in ("double", "float")}
    df.select(*[F.round(c, 12).alias(c) if c in doubles else c for c in sorted(df.columns)]).write.mode("overwrite").json(path)


def load_specification(text: str, max_bytes: int = 128 << 10) -> dict:
    """A specification in JSON (text that begins with a brace) or YAML: size-limited, without repeated keys."""
    import json

    from .plain_yaml import read

    if len(text.encode()) > max_bytes:
        raise ValueError("specification too large")
    if not text.lstrip().startswith("{"):
        return read(text)

    def unique(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=unique)
