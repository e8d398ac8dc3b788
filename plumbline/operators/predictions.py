"""Predictions in one shape from the channels' results, and dependency mutations with their expected truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ids import canonical_key, uuid5

#: What a semantic decision predicts, and the tasks and sources of channels.
DECISIONS = {"SUPPORTED": "CANDIDATE", "NOT_SUPPORTED": "NEGATIVE", "INSUFFICIENT_CONTEXT": "ABSTAIN"}
CONFIRMED, STRUCTURAL, SEMANTIC = "CONFIRMED_VIOLATION_DETECTION", "STRUCTURAL_SIGNAL_RETRIEVAL", "SEMANTIC_CANDIDATE_DETECTION"
#: Fixed value: where a mutation is put.
MARKER = "// BENCHMARK_DEPENDENCIES"


def subject_key(subjects: Column, directed: Column) -> Column:
    """The identity of subjects: whether they are directed, and the subjects in their order, or sorted if they are not."""
    return canonical_key(directed, F.array_join(F.when(directed, subjects).otherwise(F.array_sort(subjects)), "|"))


def _rows(rows: DataFrame, namespace: str, repository: str, subjects: Column, directed: Column, state: Column, source: str, task: str, origin: str) -> DataFrame:
    out = rows.select("rule_id", subjects.alias("subjects"), directed.alias("directed"), state.alias("state"), F.col(origin).cast("string").alias("origin"))
    key = subject_key(F.col("subjects"), F.col("directed"))
    name = F.concat_ws(":", F.lit(repository), "rule_id", key, F.lit(source), F.lit(task), "state")
    return out.select(uuid5(namespace, name).alias("prediction_id"), F.lit(repository).alias("repository_id"), "rule_id", key.alias("subject_key"), "state", F.lit(source).alias("source"), F.lit(task).alias("task"), "origin")


def _refuse(rows: DataFrame, why: str) -> None:
    if rows.limit(1).count():
        raise ValueError(why)


def static_predictions(findings: DataFrame, namespace: str, repository: str) -> DataFrame:
    """findings (finding, rule_id, source, target) as positive, directed predictions; cycles come from the graph."""
    _refuse(findings.filter("rule_id = 'ARCH003'"), "cycle findings are predictions of the graph")
    return _rows(findings, namespace, repository, F.array("source", "target"), F.lit(True), F.lit("POSITIVE"), "STATIC_ONLY", CONFIRMED, "finding")


def graph_predictions(candidates: DataFrame, namespace: str, repository: str) -> DataFrame:
    """candidates (candidate, rule_id, subject, object or null) as candidates: an edge is directed, a node is not."""
    edge = F.col("object").isNotNull()
    return _rows(candidates, namespace, repository, F.array_compact(F.array("subject", "object")), edge, F.lit("CANDIDATE"), "GRAPH_ONLY", STRUCTURAL, "candidate")


def cycle_predictions(findings: DataFrame, namespace: str, repository: str) -> DataFrame:
    """findings (finding, rule_id, members array) of cycles as positive, undirected predictions."""
    return _rows(findings, namespace, repository, F.col("members"), F.lit(False), F.lit("POSITIVE"), "GRAPH_ONLY", CONFIRMED, "finding")


def semantic_predictions(assessments: DataFrame, targets: DataFrame, namespace: str, repository: str) -> DataFrame:
    """assessments (candidate, rule_id, subjects, decision); one that no target (rule_id, node) asked for is an error."""
    asked = assessments.select("candidate", "rule_id", F.explode("subjects").alias("node")).join(targets.select("rule_id", "node"), ["rule_id", "node"], "left_semi")
    _refuse(assessments.join(asked.select("candidate"), "candidate", "left_anti"), "an assessment was not asked for")
    state = F.element_at(F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv]), F.col("decision"))
    return _rows(assessments, namespace, repository, F.col("subjects"), F.lit(False), state, "LLM_ONLY", SEMANTIC, "candidate")


def hybrid_predictions(decided: DataFrame, namespace: str, repository: str) -> DataFrame:
    """decided cases (anchor, rule_id, subjects, pair_source, pair_target, state): those that are proven. The pair speaks, if there is one
    and the rule is no cycle rule; pairs of dependency rules are directed."""
    own = decided.filter("state = 'CONFIRMED_DETERMINISTIC'")
    pair = F.col("pair_source").isNotNull() & (F.col("rule_id") != "ARCH003")
    subjects = F.when(pair, F.array("pair_source", "pair_target")).otherwise(F.col("subjects"))
    return _rows(own, namespace, repository, subjects, F.col("rule_id").isin("ARCH001", "ARCH002", "ARCH004", "ARCH005"), F.lit("POSITIVE"), "HYBRID", CONFIRMED, "anchor")


# -- mutations --------------------------------------------------------------------------------------------------------


def module_reference(source: Column, target: Column) -> Column:
    """The path of a module as a file names it: relative to the file's directory, without .ts, beginning with a dot."""
    a, b = F.split(F.regexp_replace(source, "/?[^/]*$", ""), "/"), F.split(F.regexp_replace(target, r"\.ts$", ""), "/")
    a = F.filter(a, lambda x: x != "")
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(a, i - 1) == F.get(b, i - 1)) & (i < F.size(b)), i).otherwise(n))
    up = F.repeat(F.lit("../"), F.size(a) - same)
    path = F.concat(up, F.array_join(F.slice(b, same + 1, F.size(b)), "/"))
    return F.when(path.startswith("."), path).otherwise(F.concat(F.lit("./"), path))


def mutated(files: DataFrame, mutations: DataFrame) -> DataFrame:
    """(mutation, path, text, problem): the changed file of each mutation (mutation, source_path, target_path, language, target_name): a
    member of the target's type in place of the marker, and in TypeScript the import it needs. A file that is not there, has the
    marker not once, carriage returns, or a name that is none, is a problem and has no text."""
    rows = mutations.join(files.select(F.col("path").alias("source_path"), "text"), "source_path", "left")
    rows = rows.join(files.select(F.col("path").alias("target_path"), F.lit(True).alias("_there")), "target_path", "left")
    java, name = F.col("language") == "JAVA", F.regexp_extract("target_name", r"([^.:]*)$", 1)
    times = (F.length("text") - F.length(F.replace("text", F.lit(MARKER), F.lit("")))) / len(MARKER)
    named = F.col("target_name").rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)*$") | (~java & name.rlike(r"^[A-Za-z_]\w*$"))
    problem = (
        F.when(~F.col("language").isin("JAVA", "TYPESCRIPT"), "LANGUAGE")
        .when(F.col("text").isNull() | F.col("_there").isNull(), "ENDPOINT")
        .when((times != 1) | F.col("text").contains("\r"), "MARKER")
        .when(~named, "NAME")
    )
    field = F.replace("text", F.lit(MARKER), F.concat("target_name", F.lit(" benchmarkDependency;")))
    member = F.replace("text", F.lit(MARKER), F.concat(F.lit("benchmarkDependency!: "), name, F.lit(";")))
    line = F.concat(F.lit("import { "), name, F.lit(" } from '"), module_reference(F.col("source_path"), F.col("target_path")), F.lit("';\n"))
    text = F.when(problem.isNull(), F.when(java, field).otherwise(F.concat(line, member)))
    return rows.select("mutation", F.col("source_path").alias("path"), text.alias("text"), problem.alias("problem"))


def verified(mutations: DataFrame, edges: DataFrame, rule: str) -> DataFrame:
    """(mutation, verified): the mutated model has the inserted dependency, edges (mutation, src_path, dst_path); for the cycle rule all
    steps of the declared cycle (paths array of three or more) are there too."""
    have = edges.select("mutation", F.col("src_path").alias("a"), F.col("dst_path").alias("b")).filter("a <> b").distinct().withColumn("_e", F.lit(True))
    step = F.array(F.struct(F.col("source_path").alias("a"), F.col("target_path").alias("b")))
    if rule == "ARCH003":
        n = F.size("paths")
        step = F.concat(step, F.transform("paths", lambda p, i: F.struct(p.alias("a"), F.get("paths", (i + 1) % n).alias("b"))))
    need = mutations.select("mutation", F.explode(step).alias("s")).select("mutation", "s.a", "s.b").distinct()
    done = need.join(have, ["mutation", "a", "b"], "left").groupBy("mutation").agg(F.bool_and(F.coalesce("_e", F.lit(False))).alias("verified"))
    if rule == "ARCH003":
        long = mutations.select("mutation", (F.size("paths") >= 3).alias("_long"))
        done = done.join(long, "mutation").withColumn("verified", F.col("verified") & F.col("_long")).drop("_long")
    return done


def expected_truth(mutations: DataFrame, namespace: str, repository: str, rule: str) -> DataFrame:
    """(case_id, repository_id, rule_id, label, subject_key, mutation): the truth that a verified mutation makes."""
    directed = F.lit(rule != "ARCH003")
    subjects = F.array("source_path", "target_path") if rule != "ARCH003" else F.col("paths")
    key = subject_key(subjects, directed)
    name = F.concat_ws(":", F.lit(repository), F.lit(rule), F.lit("POSITIVE"), key)
    return mutations.select(uuid5(namespace, name).alias("case_id"), F.lit(repository).alias("repository_id"), F.lit(rule).alias("rule_id"), F.lit("POSITIVE").alias("label"), key.alias("subject_key"), "mutation")
