"""Static conformance: classification by scopes, proven dependencies, rules, findings, status."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.globs import in_scope
from plumbline.functions.ids import canonical_key, uuid5

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
#: Relation kinds and the reference kinds that can prove them (fixed values).
REFERENCE_OF = {
    "IMPORTS": "IMPORT",
    "INHERITS": "EXTENDS",
    "IMPLEMENTS": "IMPLEMENTS",
    "CALLS": "CALL",
    "CREATES": "CREATE",
    "USES": "TYPE_USE",
}
#: Resolution methods that can prove an internal dependency (fixed values).
METHODS = (
    "EXACT_QUALIFIED",
    "EXACT_IMPORT",
    "SAME_FILE",
    "SAME_PACKAGE",
    "EXPLICIT_RELATIVE_MODULE",
    "UNIQUE_CONTAINER",
    "STATIC_QUALIFIED",
)


@dataclass(frozen=True)
class Scope:
    dimension: str  # layer or module
    name: str
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """kind: forbidden, layer, reverse or boundary. Sources and targets are layers, or modules for boundary and,
    if dimension says so, for forbidden."""

    id: str
    kind: str
    source: str
    target: str | None = None
    allow: tuple[str, ...] | None = None
    deny: tuple[str, ...] | None = None
    allow_same: bool = True
    relations: tuple[str, ...] = tuple(REFERENCE_OF)
    severity: str = "MEDIUM"
    dimension: str = "layer"
    enabled: bool = True


def validate(scopes: Sequence[Scope], rules: Sequence[Rule]) -> list[str]:
    """What is wrong with a specification; empty if nothing."""
    known = {(s.dimension, s.name) for s in scopes}
    wrong = [f"scope {s.name} twice" for i, s in enumerate(scopes) if (s.dimension, s.name) in {(x.dimension, x.name) for x in scopes[:i]}]
    wrong += [f"rule {r.id} twice" for i, r in enumerate(rules) if r.id in {x.id for x in rules[:i]}]
    for r in rules:
        dim = "module" if r.kind == "boundary" else r.dimension
        names = [r.source, *([r.target] if r.target else []), *(r.allow or ()), *(r.deny or ())]
        wrong += [f"rule {r.id}: unknown {dim} {n}" for n in names if (dim, n) not in known]
        if r.kind in ("layer", "boundary") and (r.allow is None) == (r.deny is None):
            wrong.append(f"rule {r.id}: exactly one of allow and deny")
        if r.kind == "reverse" and r.source == r.target:
            wrong.append(f"rule {r.id}: reverse needs two layers")
        if r.kind not in RULES:
            wrong.append(f"rule {r.id}: no evaluator for {r.kind}")
    return wrong


def classify(files: DataFrame, scopes: Sequence[Scope], path: str = "path") -> DataFrame:
    """files with layer, module, layer_candidates, module_candidates (comma-joined) and status. A dimension with
    more than one match is ambiguous and stays null. Scopes become columns of one pass, not a join."""
    out = files
    for dim in ("layer", "module"):
        found = [F.when(in_scope(F.col(path), s.include, s.exclude), F.lit(s.name)) for s in scopes if s.dimension == dim]
        names = F.array_sort(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")
        out = out.withColumn(f"_{dim}", names)
        out = out.withColumn(dim, F.when(F.size(f"_{dim}") == 1, F.get(f"_{dim}", F.lit(0))))
        out = out.withColumn(f"{dim}_candidates", F.array_join(f"_{dim}", ","))
    ambiguous = (F.size("_layer") > 1) | (F.size("_module") > 1)
    status = F.when(ambiguous, "AMBIGUOUS").when(F.col("layer").isNotNull() | F.col("module").isNotNull(), "CLASSIFIED").otherwise("UNCLASSIFIED")
    return out.withColumn("status", status).drop("_layer", "_module")


def proof_problem(kind: Column, proofs: Column, occurrences: Column, truncated: Column) -> Column:
    """Why an edge is not a proven dependency, asked in order; null if it is one. proofs: array of structs
    (file_path, reference_kind, resolution_status, resolution_method)."""
    expected = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in REFERENCE_OF.items()])
    return (
        F.when(~F.coalesce(kind.isin(*REFERENCE_OF), F.lit(False)), "RELATION")
        .when(F.coalesce(F.size(proofs), F.lit(0)) < 1, "NO_PROVENANCE")
        .when(~F.forall(proofs, lambda p: F.coalesce(p["resolution_status"] == "RESOLVED", F.lit(False))), "UNRESOLVED")
        .when(~F.forall(proofs, lambda p: F.coalesce(p["resolution_method"].isin(*METHODS), F.lit(False))), "METHOD")
        .when(~F.forall(proofs, lambda p: F.coalesce(p["reference_kind"] == expected, F.lit(False))), "REFERENCE_KIND")
        .when(occurrences != F.size(proofs) + truncated, "COUNT")
    )


def _violates(r: Rule) -> Column:
    return RULES[r.kind](r)


def _forbidden(r: Rule) -> Column:
    return (F.col(f"src_{r.dimension}") == r.source) & (F.col(f"dst_{r.dimension}") == r.target)


def _listed(target: Column, r: Rule) -> Column:
    return ~target.isin(*r.allow) if r.allow is not None else target.isin(*(r.deny or ()))


def _layer(r: Rule) -> Column:
    target = F.col("dst_layer")
    wrong = F.when(target.isNull(), False).when(target == r.source, not r.allow_same).otherwise(_listed(target, r))
    return (F.col("src_layer") == r.source) & wrong


def _reverse(r: Rule) -> Column:
    return (F.col("src_layer") == r.target) & (F.col("dst_layer") == r.source)


def _boundary(r: Rule) -> Column:
    target = F.col("dst_module")
    return (F.col("src_module") == r.source) & target.isNotNull() & (target != r.source) & _listed(target, r)


#: Rule kinds and what builds their predicate; a caller may add kinds.
RULES = {"forbidden": _forbidden, "layer": _layer, "reverse": _reverse, "boundary": _boundary}


def violations(deps: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """deps (src, dst, relation, occurrences, src_layer, dst_layer, src_module, dst_module) with rule_id and severity,
    one row for each rule that a dependency breaks. All rules are asked in one pass over the dependencies."""
    hits = []
    for r in rules:
        if r.enabled:
            broken = F.coalesce(_violates(r), F.lit(False)) & F.col("relation").isin(*r.relations)
            hits.append(F.when(broken, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"))))
    if not hits:
        return deps.withColumns({"rule_id": F.lit(None).cast("string"), "severity": F.lit(None).cast("string")}).limit(0)
    return deps.withColumn("_hit", F.explode(F.array_compact(F.array(*hits)))).select("*", "_hit.*").drop("_hit")


def findings(broken: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """One finding for each rule, source and target: occurrences add up, relation kinds are listed."""
    out = broken.groupBy("rule_id", "severity", F.col(source).alias("source"), F.col(target).alias("target")).agg(
        F.sum("occurrences").cast("long").alias("occurrences"),
        F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"),
    )
    return out.withColumn("finding_id", uuid5(NAMESPACE, canonical_key(F.col("rule_id"), F.col("source"), F.col("target"))))


def summary(found: DataFrame) -> DataFrame:
    """Counts by rule, by severity and in total, as one grouping-sets aggregation."""
    rows = found.groupingSets([["rule_id"], ["severity"], []], "rule_id", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.coalesce(F.sum("occurrences"), F.lit(0)).cast("long").alias("occurrences"), F.grouping_id().alias("_g")
    )
    return rows.select(F.when(F.col("_g") == 1, "rule").when(F.col("_g") == 2, "severity").otherwise("total").alias("dimension"), F.coalesce("rule_id", "severity", F.lit("*")).alias("value"), "findings", "occurrences")


def status(invalid: Column, n_findings: Column, incomplete: Column) -> Column:
    """Invalid comes first, then findings, then gaps that leave conformance open."""
    return F.when(invalid, "INVALID").when(n_findings > 0, "NON_CONFORMANT").when(incomplete, "INCOMPLETE").otherwise("CONFORMANT")
