"""The whole way from a source tree to findings: intake, facts, resolution, model, conformance, graph rules.

Each step is a DataFrame; the tree is read once and its facts are kept by a checkpoint, as several steps rest on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import conformance as C
from plumbline.operators import graph as G
from plumbline.operators import resolution as R
from plumbline.sources import extract, intake

#: Reference kinds and the relation that they prove.
RELATION_OF = {v: k for k, v in C.REFERENCE_OF.items()}


def model(spark: SparkSession, root: str, exclude: Sequence[str] = ()) -> dict[str, DataFrame]:
    """files, nodes (node, kind, name, path, parent), references (with status, method, target), edges (file to file,
    with relation, occurrences and proofs) and problems (path, problem)."""
    files = intake.classified(intake.scan(spark, root))
    files = files.filter(intake.excluded_by(F.col("path"), exclude).isNull())
    facts = G.checkpointed(extract.extract(files.filter("analysis_eligible")))
    files = files.drop("content")
    declared = facts.filter("fact = 'DECLARATION'").select("path", "kind", "name", "container")
    types = declared.filter(F.col("kind").isin("CLASS", "INTERFACE", "ENUM", "RECORD"))
    nodes = declared.select(F.concat_ws("#", "path", "name").alias("node"), "kind", "name", "path", F.concat_ws("#", "path", F.coalesce("container", F.lit(""))).alias("_up"), "container").distinct()
    nodes = nodes.withColumn("parent", F.when(F.col("container").isNull(), F.col("path")).otherwise(F.col("_up"))).drop("_up", "container")
    nodes = nodes.union(files.filter("analysis_eligible").select("path", F.lit("FILE"), "path", "path", F.lit(None).cast("string")))

    imports = facts.filter("fact = 'IMPORT'").withColumn("ref", F.monotonically_increasing_id())
    imports = G.checkpointed(imports.select("ref", "path", "name", "kind", F.col("target").alias("specifier"), "line"))
    java = imports.join(types.select(F.col("name").alias("specifier"), F.col("path").alias("t")), "specifier").select("ref", "t")
    local = imports.filter("specifier like '.%'").select(F.col("ref").alias("import_id"), "path", "specifier")
    local = R.relative_modules(local, files.select("path")).filter("status <> 'UNRESOLVED'").select(F.col("import_id").alias("ref"), F.col("target").alias("t"))
    found = R.ladder(imports, [("EXACT_IMPORT", java, True), ("EXPLICIT_RELATIVE_MODULE", local.filter("t is not null"), True)], "ref", "t").withColumn("reference", F.lit("IMPORT"))

    uses = facts.filter("fact = 'REFERENCE'").withColumn("ref", F.monotonically_increasing_id())
    uses = G.checkpointed(uses.select("ref", "path", "kind", "container", "line", F.regexp_extract("name", r"^([^.]*)", 1).alias("name")))
    simple = types.select(F.regexp_extract("name", r"([^.]*)$", 1).alias("name"), F.col("path").alias("t"), F.regexp_replace("path", "[^/]*$", "").alias("dir"))
    same = uses.join(simple.select("name", F.col("t").alias("path")), ["name", "path"]).select("ref", F.col("path").alias("t"))
    bound = uses.join(found.filter("status = 'RESOLVED'").select("path", "name", F.col("target").alias("t")), ["path", "name"]).select("ref", "t")
    package = uses.withColumn("dir", F.regexp_replace("path", "[^/]*$", "")).filter("path like '%.java'").join(simple.filter("t like '%.java'"), ["name", "dir"]).select("ref", "t")
    anywhere = uses.join(simple, "name").select("ref", "t")
    stages = [("SAME_FILE", same, True), ("EXACT_IMPORT", bound, True), ("SAME_PACKAGE", package, True), ("GLOBAL", anywhere, False)]
    resolved = R.ladder(uses, stages, "ref", "t").withColumn("reference", F.col("kind"))
    columns = ["path", "name", "line", "reference", "method", "status", "target"]
    references = found.select(*columns).union(resolved.select(*columns))

    pairs = [F.lit(x) for kv in RELATION_OF.items() for x in kv]
    proven = references.filter("status = 'RESOLVED'").select(
        F.col("path").alias("source"), "target", F.try_element_at(F.create_map(*pairs), "reference").alias("kind"), F.col("path").alias("file_path"), "line", F.lit(1).alias("col"), F.concat_ws("|", "name", "method").alias("key")
    )
    edges = R.edges_with_provenance(proven.filter("kind is not null")).withColumnsRenamed({"source": "src", "target": "dst", "kind": "relation"})
    problems = facts.filter("fact = 'PROBLEM'").select("path", F.col("kind").alias("problem"))
    return {"files": files, "nodes": nodes, "references": references, "edges": edges, "problems": problems}


def cycle_findings(edges: DataFrame, rule_id: str, max_trace: int = 256) -> DataFrame:
    """(rule_id, component, size, trace): one finding for each strongly connected component of two or more vertices; the
    trace is a closed path. A component whose proof was cut gives no finding."""
    own = edges.filter("src <> dst").select("src", "dst").distinct()
    names = own.select(F.col("src").alias("v")).union(own.select("dst")).distinct()
    members = G.checkpointed(G.scc(names, own))
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    steps = G.cycle_proofs(members, own, max_trace).filter("not truncated")
    trace = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "v"))), lambda x: x["v"]), " -> ")
    return steps.groupBy("component").agg(trace.alias("trace")).join(size, "component").select(F.lit(rule_id).alias("rule_id"), "component", "size", "trace")


def check(spark: SparkSession, root: str, scopes: Sequence[C.Scope], rules: Sequence[C.Rule], cycle_rule: str | None = None) -> dict[str, DataFrame]:
    """findings, cycles, classification, problems and status (one row). A specification that is wrong, or a file in two
    layers or modules, makes the check INVALID and leaves no findings; files with problems make it INCOMPLETE."""
    wrong = C.validate(scopes, rules)
    parts = model(spark, root)
    files = C.classify(parts["files"].filter("analysis_eligible"), scopes)
    valid = files.filter("status = 'AMBIGUOUS'").groupBy().agg((F.count(F.lit(1)) == 0).alias("valid")).withColumn("valid", F.col("valid") & F.lit(not wrong))
    ends = [files.select(F.col("path").alias(e), F.col("layer").alias(f"{e}_layer"), F.col("module").alias(f"{e}_module")) for e in ("src", "dst")]
    deps = parts["edges"].filter("src <> dst").join(ends[0], "src").join(ends[1], "dst")
    found = C.findings(C.violations(deps, [] if wrong else rules)).join(F.broadcast(valid), F.lit(True)).filter("valid").drop("valid")
    found = G.checkpointed(found)
    cycles = G.checkpointed(cycle_findings(parts["edges"], cycle_rule).join(F.broadcast(valid), F.lit(True)).filter("valid").drop("valid")) if cycle_rule else None
    n = found.agg(F.count(F.lit(1)).alias("n"))
    if cycles is not None:
        n = n.union(cycles.agg(F.count(F.lit(1)))).agg(F.sum("n").alias("n"))
    bad = parts["problems"].agg((F.count(F.lit(1)) > 0).alias("incomplete"))
    one = valid.join(n, F.lit(True)).join(bad, F.lit(True))
    state = one.select(C.status(~F.col("valid"), F.col("n"), F.col("incomplete")).alias("status"), F.col("n").alias("findings"))
    return {"findings": found, "cycles": cycles, "classification": files, "problems": parts["problems"], "status": state}
