"""Reference resolution as joins: priority ladders, arity, modules, locators; model construction and checks.

Ambiguity is never settled by a first match: candidates are counted, and only one distinct candidate resolves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def choose(references: DataFrame, candidates: DataFrame, key: str, target: str) -> DataFrame:
    """references (key) with status RESOLVED (one distinct candidate), AMBIGUOUS (more), UNRESOLVED (none) and target.
    candidates: (key, target). Candidates are counted before the join."""
    per = candidates.groupBy(key).agg(F.count_distinct(target).alias("n"), F.min(target).alias("_one"))
    out = references.join(per, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") == 1, "RESOLVED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("UNRESOLVED")
    return out.withColumns({"status": status, "target": F.when(F.col("n") == 1, F.col("_one"))}).drop("_one").withColumnRenamed("n", "candidates")


def ladder(references: DataFrame, stages: Sequence[tuple[str, DataFrame, bool]], key: str, target: str) -> DataFrame:
    """references with method, status and target of the first stage that has any candidate. stages: (method, candidates
    (key, target), may_resolve); a stage that may not resolve says AMBIGUOUS for several and UNRESOLVED for one."""
    rows = None
    for i, (method, found, may) in enumerate(stages):
        own = found.select(key, F.col(target).alias("_t"), F.struct(F.lit(i).alias("i"), F.lit(method).alias("m"), F.lit(may).alias("may")).alias("_s"))
        rows = own if rows is None else rows.unionByName(own)
    per = rows.groupBy(key, "_s").agg(F.count_distinct("_t").alias("n"), F.min("_t").alias("t"))
    first = per.groupBy(key).agg(F.min(F.struct("_s", "n", "t")).alias("f"))
    out = references.join(first, key, "left")
    n, may = F.col("f.n"), F.col("f._s.may")
    status = F.when(n > 1, "AMBIGUOUS").when((n == 1) & may, "RESOLVED").otherwise("UNRESOLVED")
    return out.select(*references.columns, F.col("f._s.m").alias("method"), status.alias("status"), F.when(status == "RESOLVED", F.col("f.t")).alias("target"))


def arity_fits(n: Column, low: Column, high: Column, rest: Column) -> Column:
    """True if n arguments fit; an unknown number fits all, rest parameters have no upper bound."""
    return n.isNull() | ((n >= low) & (rest | (n <= high)))


def normalised(path: Column) -> Column:
    """A POSIX path without ., .. and empty segments; null if it climbs above its root."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    done = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))),
    )
    return F.array_join(done, "/")


MODULE_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def relative_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (import_id, path, specifier) resolved to files (path): candidates are the joined path with each ending."""
    base = normalised(F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("specifier")))
    tries = imports.select("import_id", F.explode(F.array(*[F.concat(base, F.lit(e)) for e in MODULE_ENDINGS])).alias("target"))
    found = tries.join(files.select(F.col("path").alias("target")), "target", "left_semi").select("import_id", "target")
    return choose(imports, found, "import_id", "target")


def locate(locators: DataFrame, nodes: DataFrame) -> DataFrame:
    """locators (locator_id, path, kind, qualified_name, signature) -> status MISSING, RESOLVED or AMBIGUOUS; a null
    signature fits any."""
    right = nodes.select("path", "kind", "qualified_name", F.col("signature").alias("_sig"), F.col("node").alias("target"))
    found = locators.join(right, ["path", "kind", "qualified_name"]).filter("signature is null or signature = _sig").select("locator_id", "target")
    out = choose(locators, found, "locator_id", "target")
    return out.withColumn("status", F.when(F.col("status") == "UNRESOLVED", "MISSING").otherwise(F.col("status")))


def by_name(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """names (name) to the one node whose id, name or qualified name it is: three equi-joins instead of a disjunction."""
    own = nodes.filter(~F.col("kind").isin("PROJECT", "PACKAGE", "EXTERNAL"))
    keys = own.select(F.explode(F.array("node", "name", "qualified_name")).alias("name"), F.col("node").alias("target")).distinct()
    return choose(names, names.join(keys, "name").select("name", "target"), "name", "target")


# -- the model ---------------------------------------------------------------------------------------------------


def package_prefixes(names: DataFrame, column: str = "package") -> DataFrame:
    """(package, parent): every dotted prefix once."""
    parts = F.split(column, r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    own = names.filter(F.col(column).isNotNull() & (F.col(column) != "")).select(F.explode(ups).alias("package")).distinct()
    return own.withColumn("parent", F.nullif(F.regexp_replace("package", r"\.?[^.]*$", ""), F.lit("")))


def edges_with_provenance(references: DataFrame, keep: int = 1_000) -> DataFrame:
    """references (source, target, kind, file_path, line, col, key) -> one edge a source, target and kind: occurrences of
    all, the first `keep` proofs in order, and how many were left out. Ranks use a group limit, so only kept proofs are
    gathered."""
    group = ["source", "target", "kind"]
    order = W.partitionBy(*group).orderBy("file_path", "line", "col", "key")
    counts = references.groupBy(*group).agg(F.count(F.lit(1)).alias("occurrences"))
    first = references.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep)
    proofs = first.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("file_path", "line", "col", "key"))).alias("proofs"))
    return counts.join(proofs, group).withColumn("provenance_truncated", F.col("occurrences") - F.size("proofs"))


def missing_references(rows: DataFrame, column: str, target: DataFrame, target_key: str, check: str, row_id: str) -> DataFrame:
    """(check, id): rows whose non-null reference is not there."""
    right = target.select(F.col(target_key).alias(column)).distinct()
    return rows.filter(F.col(column).isNotNull()).join(right, column, "left_anti").select(F.lit(check).alias("check"), F.col(row_id).cast("string").alias("id"))


def duplicates(rows: DataFrame, column: str, check: str) -> DataFrame:
    """(check, id): values that are not unique."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(check).alias("check"), F.col(column).cast("string").alias("id"))


def model_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, id) for every broken rule of a model: unique ids, edge ends, parents, one root, proofs that add up."""
    roots = nodes.filter("parent is null").agg(F.count(F.lit(1)).alias("n")).filter("n <> 1").select(F.lit("one root").alias("check"), F.col("n").cast("string").alias("id"))
    out = duplicates(nodes, "node", "node id twice").union(duplicates(edges, "edge", "edge id twice"))
    for end in ("src", "dst"):
        out = out.union(missing_references(edges, end, nodes, "node", f"edge {end}", "edge"))
    out = out.union(missing_references(nodes, "parent", nodes, "node", "node parent", "node")).union(roots)
    wrong = edges.filter("occurrences <> proofs + truncated").select(F.lit("proof count").alias("check"), F.col("edge").cast("string").alias("id"))
    return out.union(wrong)


def at_granularity(found: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """found (id, node) -> (id, target): the node of the wanted kind: itself, its nearest ancestor of that kind, or for a FILE
    its only child of that kind; null if there is none or several."""
    from .graph import owners_of

    up = owners_of(nodes, (kind,))
    child = nodes.filter(F.col("kind") == kind).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("child"))
    rows = found.join(up, "node", "left").join(child, "node", "left").join(nodes.select("node", F.col("kind").alias("_k")), "node", "left")
    only = F.when((F.col("_k") == "FILE") & (F.col("n") == 1), F.col("child"))
    return rows.select("id", F.coalesce("owner", only).alias("target"))


def completeness(outcomes: DataFrame) -> DataFrame:
    """outcomes (group, status, errors): valid if nothing is an error, complete if every file was parsed without errors."""
    return outcomes.groupBy("group").agg(F.bool_and(F.col("status") != "ERROR").alias("valid"), F.bool_and((F.col("status") == "PARSED") & (F.col("errors") == 0)).alias("complete"), F.count(F.lit(1)).alias("files"))


def shadowed(references: DataFrame, shadows: DataFrame, containers: DataFrame) -> DataFrame:
    """references (ref, name, scope) with is_shadowed: a local binding of the name, shadows (scope, name), stands in the scope of the
    reference, in one that contains it (containers: scope, parent), or in the file (scope null). Such a name says nothing of
    a declaration elsewhere, so the reference is not resolved."""
    from .graph import ancestors

    up = ancestors(containers.select(F.col("scope").alias("child"), "parent")).select(F.col("node").alias("scope"), F.col("ancestor").alias("at"))
    own = references.select("ref", "name", F.col("scope").alias("at"))
    outer = references.select("ref", "name", "scope").join(up, "scope").select("ref", "name", "at")
    bound = shadows.select(F.col("scope").alias("at"), "name").distinct()
    hit = own.union(outer).join(bound.filter("at is not null"), ["at", "name"], "left_semi").select("ref")
    hit = hit.union(references.select("ref", "name").join(bound.filter("at is null").select("name"), "name", "left_semi").select("ref")).distinct()
    return references.join(hit.withColumn("_hit", F.lit(True)), "ref", "left").withColumn("is_shadowed", F.col("_hit").isNotNull()).drop("_hit")
