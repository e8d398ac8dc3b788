"""Evidence around subjects: owners, constraints, numbered context rows, checked answers, cases, proofs, bundles, guards.

All of it is per context or per case, for many at once: rows of all contexts in one table, numbered and gathered by context.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions.ids import uuid5
from plumbline.functions.strict import object_problem

from .graph import ancestors

#: Kinds that speak for a component last, and kinds that may own architecture.
LAST_KINDS = ("FILE", "FIELD", "METHOD")
OWNER_KINDS = ("CLASS", "INTERFACE", "ENUM", "TYPE_ALIAS", "FUNCTION")
#: Prefixes of evidence numbers by kind.
EVIDENCE = {"TARGET_CONSTRAINT": "ARC", "DEPENDENCY": "DEP", "DISCOVERY_HYPOTHESIS": "DISC", "GRAPH_METRIC": "GRAPH"}
#: Claims of code or places that an answer must not make.
CODE, PLACE = r"[`{};]", r"(?i)\b(?:line|lines|строк[аеуи]?)\s*[:#]?\s*\d|\.(?:java|tsx?|jsx?)\b|[/\\]"
MAX_ANSWER = 32_768
#: Formats of identities, and the order of case types.
CASE_NAME, BUNDLE_NAME, REQUEST_NAME = "hybrid-case-v1", "evidence-bundle-v1", "requested-semantic-target-v1"
CASE_ORDER = {"DETERMINISTIC_CONFORMANCE": 0, "GRAPH_STRUCTURAL": 1, "SEMANTIC": 2, "COMPOSITE": 3}


# -- owners -------------------------------------------------------------------------------------------------------


def sole_owners(members: DataFrame) -> DataFrame:
    """members (owner, node) -> (node, owners, owner): the owner, if there is exactly one."""
    per = members.groupBy("node").agg(F.count_distinct("owner").alias("owners"), F.min("owner").alias("_o"))
    return per.select("node", "owners", F.when(F.col("owners") == 1, F.col("_o")).alias("owner"))


def representatives(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """members (owner, node), nodes (node, kind) -> (owner, node): the smallest member, files, fields and methods last."""
    rows = members.join(nodes.select("node", "kind"), "node")
    best = rows.groupBy("owner").agg(F.min(F.struct(F.col("kind").isin(*LAST_KINDS).alias("last"), "node")).alias("b"))
    return best.select("owner", "b.node")


def architectural_owners(graph_nodes: DataFrame, members: DataFrame, discovered: DataFrame, containment: DataFrame) -> DataFrame:
    """graph_nodes (node, kind) -> (node, owner, how). members: (node, member, kind); discovered: (node, member); containment:
    (child, parent). Asked in this order: the node itself, if it is a member that may own (IDENTITY), or a file without such members
    (FILE); the representative that discovery names (DISCOVERY; INVALID if there are several, or it is no member that may own); the
    only such member that no other contains (ROOT). Otherwise MISSING or AMBIGUOUS, without an owner."""
    own = members.filter(F.col("kind").isin(*OWNER_KINDS)).select("node", "member").distinct()
    up = ancestors(containment).select(F.col("node").alias("member"), "ancestor")
    above = own.select("node", F.col("member").alias("ancestor"))
    inner = own.join(up, "member").join(above, ["node", "ancestor"], "left_semi").select("node", "member").distinct()
    roots = own.join(inner, ["node", "member"], "left_anti").groupBy("node").agg(F.count(F.lit(1)).alias("roots"), F.min("member").alias("root"))
    facts = own.groupBy("node").agg(F.count(F.lit(1)).alias("candidates"), F.max(F.col("member") == F.col("node")).alias("itself"))
    files = members.filter((F.col("kind") == "FILE") & (F.col("member") == F.col("node"))).select("node", F.lit(True).alias("file")).distinct()
    known = discovered.select("node", "member").distinct().join(own.withColumn("good", F.lit(True)), ["node", "member"], "left")
    known = known.groupBy("node").agg(F.count(F.lit(1)).alias("named"), F.min("member").alias("name"), F.bool_and(F.coalesce("good", F.lit(False))).alias("good"))
    rows = graph_nodes.select("node", F.col("kind").alias("_k"))
    for part in (facts, files, known, roots):
        rows = rows.join(part, "node", "left")
    how = (
        F.when(F.coalesce("itself", F.lit(False)), "IDENTITY")
        .when(F.col("candidates").isNull() & F.col("file") & (F.col("_k") == "FILE"), "FILE")
        .when(F.col("named").isNotNull(), F.when((F.col("named") == 1) & F.col("good"), "DISCOVERY").otherwise("INVALID"))
        .when(F.col("roots") == 1, "ROOT")
        .when(F.col("candidates").isNull(), "MISSING")
        .otherwise("AMBIGUOUS")
    )
    owner = F.when(how.isin("IDENTITY", "FILE"), F.col("node")).when(how == "DISCOVERY", F.col("name")).when(how == "ROOT", F.col("root"))
    return rows.select("node", owner.alias("owner"), how.alias("how"))


# -- context ------------------------------------------------------------------------------------------------------


def numbered(rows: DataFrame, prefix: Column, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """rows (context, ...) with evidence_id: prefix and the place in the order within the context (and `by`), of three digits at
    least."""
    place = F.row_number().over(W.partitionBy("context", *by).orderBy(*order)).cast("string")
    return rows.withColumn("evidence_id", F.concat(prefix, F.when(F.length(place) < 3, F.lpad(place, 3, "0")).otherwise(place)))


def numbered_evidence(rows: DataFrame) -> DataFrame:
    """rows (context, kind, key, ...) with evidence_id: DEP001, DISC001, ... by kind within a context, in the order of keys."""
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv]), F.col("kind"))
    return numbered(rows, prefix, ["key"], ["kind"])


def relevant_constraints(rules: DataFrame, selected: DataFrame) -> DataFrame:
    """(context, rule_id, evidence_id, layers, modules, ambiguous): the enabled rules that speak of the layers or modules of the
    selected subjects of a context, in the order of rules.

    rules: (place, rule_id, type, enabled, source_layer, source_module, target_layer, target_module); selected: (context, layer,
    module, layer_candidates, module_candidates). A forbidden dependency is told by any of its sides, a layer or module rule by its
    source, a reverse dependency by either layer, a cycle rule by any classified subject. Each rule is an equi-join on
    (dimension, name), not a product of rules and contexts."""
    side = lambda dim, column, *types: F.when(F.col("type").isin(*types), F.struct(F.lit(dim).alias("dim"), F.col(column).alias("name")))
    told = F.array(
        side("layer", "source_layer", "FORBIDDEN", "LAYER", "REVERSE"),
        side("layer", "target_layer", "FORBIDDEN", "REVERSE"),
        side("module", "source_module", "FORBIDDEN", "MODULE"),
        side("module", "target_module", "FORBIDDEN"),
        F.when(F.col("type") == "CIRCULAR", F.struct(F.lit("any").alias("dim"), F.lit("").alias("name"))),
    )
    keys = rules.filter("enabled").select("place", "rule_id", F.explode(F.array_compact(told)).alias("k")).select("place", "rule_id", "k.dim", "k.name")
    has = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("name")) for d in ("layer", "module")], F.struct(F.lit("any").alias("dim"), F.lit("").alias("name")))
    facts = selected.select("context", F.explode(has).alias("k")).select("context", "k.dim", "k.name").filter("name is not null").distinct()
    found = facts.join(keys, ["dim", "name"]).select("context", "place", "rule_id").distinct()
    open_ = (F.col("layer").isNull() & (F.col("layer_candidates") > 0)) | (F.col("module").isNull() & (F.col("module_candidates") > 0))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s")
    about = selected.groupBy("context").agg(names("layer"), names("module"), F.bool_or(open_).alias("ambiguous"))
    return numbered(found, F.lit("ARC"), ["place"]).join(about, "context").select("context", "rule_id", "evidence_id", "layers", "modules", "ambiguous")


def answer_problems(answers: DataFrame, targets: DataFrame, subjects: DataFrame, references: DataFrame) -> DataFrame:
    """(answer, problem): the first reason why an answer is refused, or null. answers: (answer, target, rule, subjects array,
    refs array, text, json); targets: (target, node, rule); subjects (target, node) and references (target, ref) are what the
    context of a target supplied, a bounded list."""
    given = subjects.groupBy("target").agg(F.collect_set("node").alias("_nodes"))
    cited = references.groupBy("target").agg(F.collect_set("ref").alias("_refs"))
    rows = answers.join(targets.select("target", F.col("node").alias("_node"), F.col("rule").alias("_rule")), "target", "left")
    rows = rows.join(given, "target", "left").join(cited, "target", "left")
    inside = lambda part, whole: F.coalesce(F.size(F.array_except(part, whole)) == 0, F.size(part) == 0)
    problem = (
        F.when(F.length("json") > MAX_ANSWER, "SIZE")
        .when(object_problem(F.col("json")).isNotNull(), object_problem(F.col("json")))
        .when(F.coalesce(F.col("rule") != F.col("_rule"), F.lit(True)), "RULE")
        .when(~F.array_contains("subjects", F.col("_node")), "TARGET")
        .when(~inside(F.col("subjects"), F.col("_nodes")), "SUBJECTS")
        .when(~inside(F.col("refs"), F.col("_refs")), "REFERENCES")
        .when(F.coalesce(F.col("text").rlike(CODE) | F.col("text").rlike(PLACE), F.lit(False)), "LOCATION")
    )
    return rows.select("answer", problem.alias("problem"))


# -- cases and bundles ----------------------------------------------------------------------------------------------


def cases(namespace: str, findings: DataFrame, candidates: DataFrame, assessments: DataFrame, targets: DataFrame) -> DataFrame:
    """(case_id, bundle_id, case_type, origin, rule_id, anchor, scope, subjects): one case a finding (id, rule_id, subjects, scope), a
    graph candidate (the same), a semantic assessment (id, rule_id, subjects, target), and one for each requested (target, rule_id)
    that no assessment answers. Identities are names of type, origin, rule, anchor, scope and sorted subjects."""
    cyclic = F.when(F.col("rule_id") == "ARCH003", "GRAPH_CONFORMANCE").otherwise("STATIC")

    def of(rows: DataFrame, kind: str, origin: Column, scope: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("case_type"), origin.alias("origin"), "rule_id", F.col("id").alias("anchor"), scope.alias("scope"), F.array_sort("subjects").alias("subjects"))

    open_ = targets.select("target", "rule_id").distinct().join(assessments.select("target", "rule_id"), ["target", "rule_id"], "left_anti")
    name = F.concat_ws(":", F.lit(REQUEST_NAME), "target", "rule_id")
    open_ = open_.select(uuid5(namespace, name).alias("id"), "rule_id", F.array(F.col("target").cast("string")).alias("subjects"))
    rows = of(findings, "DETERMINISTIC_CONFORMANCE", cyclic, F.coalesce("scope", F.lit("iam-dependency")))
    rows = rows.union(of(candidates, "GRAPH_STRUCTURAL", F.lit("GRAPH"), F.col("scope")))
    rows = rows.union(of(assessments, "SEMANTIC", F.lit("AI"), F.lit("semantic-assessment")))
    rows = rows.union(of(open_, "SEMANTIC", F.lit("CALLER"), F.lit("requested-semantic-target")))
    identity = F.concat_ws(":", F.lit(CASE_NAME), "case_type", "origin", "rule_id", "anchor", "scope", F.array_join("subjects", ":"))
    rows = rows.withColumn("case_id", uuid5(namespace, identity))
    return rows.select("case_id", uuid5(F.col("case_id"), F.lit(BUNDLE_NAME)).alias("bundle_id"), "case_type", "origin", "rule_id", "anchor", "scope", "subjects")


def in_case_order(rows: DataFrame) -> DataFrame:
    order = F.element_at(F.create_map(*[F.lit(x) for kv in CASE_ORDER.items() for x in kv]), F.col("case_type"))
    return rows.orderBy(order, "rule_id", "case_id")


def checked_proofs(findings: DataFrame, records: DataFrame, edges: DataFrame, specification: str | None = None) -> DataFrame:
    """(finding, records, unmatched, closed, valid): a proof's records (finding, seq, edge, source, target, relation) must be real
    directed edges (edge, src, dst, kind); those of a cycle finding (rule_id ARCH003) must lead from each to the next and back to the
    start; the finding (finding, rule_id, specification) must name the specification, and the expected one if that is known."""
    real = edges.select("edge", F.col("src").alias("source"), F.col("dst").alias("target"), F.col("kind").alias("relation"), F.lit(True).alias("real"))
    rows = records.join(real, ["edge", "source", "target", "relation"], "left")
    w = W.partitionBy("finding").orderBy("seq")
    gap = F.lead("source").over(w) != F.col("target")
    rows = rows.withColumns({"_gap": F.coalesce(gap, F.lit(False))})
    per = rows.groupBy("finding").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("real").isNull()).alias("unmatched"),
        (~F.max("_gap") & (F.min_by("source", "seq") == F.max_by("target", "seq"))).alias("closed"),
    )
    out = findings.join(per, "finding", "left").na.fill(0, ["records", "unmatched"]).withColumn("closed", F.coalesce("closed", F.lit(False)))
    named = F.col("specification").isNotNull() if specification is None else F.coalesce(F.col("specification") == specification, F.lit(False))
    valid = named & (F.col("unmatched") == 0) & ((F.col("rule_id") != "ARCH003") | F.col("closed"))
    return out.select("finding", "records", "unmatched", "closed", valid.alias("valid"))


def alignments(cases_: DataFrame, evidence: DataFrame, channels: Sequence[str] = ("ai", "graph", "discovery")) -> DataFrame:
    """evidence (case_id, channel, ref, method, agreement, reason) of the cases, and a row with agreement MISSING for each channel that
    says nothing of a case."""
    own = evidence.join(cases_.select("case_id"), "case_id", "left_semi").select("case_id", "channel", "ref", "method", "agreement", "reason")
    every = cases_.select("case_id", F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"))
    none = every.join(own.select("case_id", "channel").distinct(), ["case_id", "channel"], "left_anti")
    reason = F.concat(F.lit("MISSING_"), F.upper("channel"), F.lit("_EVIDENCE"))
    return own.union(none.select("case_id", "channel", F.concat(F.lit("missing:"), "channel"), F.lit(None).cast("string"), F.lit("MISSING"), reason))


def bundles(aligned: DataFrame, channels: Sequence[str] = ("ai", "graph", "discovery")) -> DataFrame:
    """One row a case of alignments(): the refs of each channel in order, and how many support, contradict or are missing."""
    refs = [F.array_sort(F.collect_list(F.when((F.col("channel") == c) & (F.col("agreement") != "MISSING"), F.col("ref")))).alias(c) for c in channels]
    counts = [F.count_if(F.col("agreement") == a).alias(a.lower()) for a in ("SUPPORTING", "CONTRADICTING", "MISSING")]
    return aligned.groupBy("case_id").agg(*refs, *counts)


def hybrid_statistics(cases_: DataFrame) -> DataFrame:
    """cases (case_type, state, supporting, contradicting, missing) -> counts by type, by state and in total."""
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in ("supporting", "contradicting", "missing")]
    rows = cases_.groupingSets([["case_type"], ["state"], []], "case_type", "state").agg(F.count(F.lit(1)).alias("cases"), *sums, F.grouping_id().alias("_g"))
    dim = F.when(F.col("_g") == 1, "case_type").when(F.col("_g") == 2, "state").otherwise("total")
    return rows.select(dim.alias("dimension"), F.coalesce("case_type", "state", F.lit("*")).alias("value"), "cases", "supporting", "contradicting", "missing")


# -- guards on what is put together -----------------------------------------------------------------------------------


def channel_problems(model: Mapping[str, str | None], **channels: Mapping[str, object] | None) -> list[str]:
    """Why results cannot be fused with a model; empty if they can. model: project, fingerprint, specification. Each channel that is there
    must be of the same project and fingerprint; static must name the same specification, graph that or none and be a component
    projection; discovery needs the graph it was made from (configuration and projection)."""
    out = []
    for name, facts in channels.items():
        if facts is not None and any(facts.get(k) != model.get(k) for k in ("project", "fingerprint")):
            out.append(f"{name} is of another model")
    static, graph, discovery = (channels.get(c) for c in ("static", "graph", "discovery"))
    if static is not None and static.get("specification") != model.get("specification"):
        out.append("static is of another specification")
    if graph is not None:
        if graph.get("projection") != "COMPONENT":
            out.append("graph is no component projection")
        if graph.get("specification") not in (None, model.get("specification")):
            out.append("graph is of another specification")
    if discovery is not None and (graph is None or any(discovery.get(f"graph_{k}") != graph.get(k) for k in ("configuration", "projection_fingerprint"))):
        out.append("discovery is of another graph")
    return out


def binding_problems(model: Mapping[str, str | None], graph: Mapping[str, object], configuration: object) -> list[str]:
    """Why layers and modules cannot be discovered from a graph result: another model or configuration, or a result that knows the target
    architecture (findings, conformance or a specification), which discovery must not see."""
    out = []
    if any(graph.get(k) != model.get(k) for k in ("project", "fingerprint")) or graph.get("configuration") != configuration:
        out.append("graph is of another model or configuration")
    if graph.get("findings") or graph.get("conformance") is not None or graph.get("specification") is not None:
        out.append("graph knows the target architecture")
    return out
