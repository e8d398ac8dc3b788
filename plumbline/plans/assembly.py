"""Queries of evidence assembly, predictions, mutations, security across functions, and single checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import assembly as A
from plumbline.operators import discovery as D
from plumbline.operators import graph as G
from plumbline.operators import interprocedural as X
from plumbline.operators import predictions as P
from plumbline.operators import resolution as R
from plumbline.operators import security as S
from plumbline.sources import intake as I

from .adapters import oracle, relation, table

QUERIES, ORACLES = {}, {}
SPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def query(sql: str | None = None, *names: str, recursive: bool = False):
    """Registers a query under its function's name, with its oracle over the named relations."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql, *names, recursive=recursive)
        return f

    return add


def _uuid(name: str, space: str = f"'{SPACE}'") -> str:
    """SQL of a version-5 UUID."""
    h = f"sha1(unhex(replace({space}, '-', '')) || encode({name}))"
    cut = lambda a, n: f"substr({h}, {a}, {n})"
    return f"({cut(1, 8)} || '-' || {cut(9, 4)} || '-5' || {cut(14, 3)} || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', {cut(17, 1)}), 1) || {cut(18, 3)} || '-' || {cut(21, 12)})"


def _pick(column, *values):
    """One of the values by a number modulo their count."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (column % len(values) + 1).cast("int"))


# -- owners -------------------------------------------------------------------------------------------------------


@query("""SELECT l_partkey AS node, count(DISTINCT l_suppkey)::BIGINT AS owners, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS owner FROM lineitem WHERE l_linenumber > 0 GROUP BY l_partkey""")
def sole_owners(spark, sf_dir):
    return A.sole_owners(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("node")))


@query("""SELECT l_suppkey AS owner, arg_min(p_partkey, (p_partkey % 5 IN (0, 2, 3))::BIGINT * 1000000000000 + p_partkey) AS node FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey""")
def representatives(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), _pick(F.col("p_partkey"), "FILE", "CLASS", "METHOD", "FIELD", "INTERFACE").alias("kind"))
    return A.representatives(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("node")), nodes)


@query(
    """WITH RECURSIVE p AS (SELECT p_partkey AS m, p_partkey - p_partkey % 8 AS node, ['FILE', 'CLASS', 'METHOD', 'FIELD', 'ENUM', 'PACKAGE', 'METHOD'][p_partkey % 7 + 1] AS kind, CASE WHEN p_partkey % 8 IN (1, 2, 5, 6) THEN p_partkey - 1 END AS parent FROM part),
n AS (SELECT DISTINCT node, CASE WHEN node % 16 = 0 THEN 'FILE' ELSE 'CLASS' END AS kind FROM p),
u AS (SELECT m, parent AS a FROM p WHERE parent IS NOT NULL UNION SELECT u.m, p.parent FROM u JOIN p ON p.m = u.a WHERE p.parent IS NOT NULL),
c AS (SELECT * FROM p WHERE kind IN ('CLASS', 'ENUM')),
r AS (SELECT c.node, count(*) AS roots, min(m) AS root FROM c WHERE NOT EXISTS (SELECT 1 FROM u JOIN c AS o ON o.m = u.a WHERE u.m = c.m AND o.node = c.node) GROUP BY c.node),
d AS (SELECT node, node + 1 AS m FROM n WHERE node % 24 = 0 UNION ALL SELECT node, node + 3 FROM n WHERE node % 72 = 0),
k AS (SELECT d.node, count(*) AS named, min(d.m) AS name, bool_and(c.m IS NOT NULL) AS good FROM d LEFT JOIN c ON c.node = d.node AND c.m = d.m GROUP BY d.node),
f AS (SELECT n.*, (SELECT count(*) FROM c WHERE c.node = n.node) AS candidates, (SELECT count(*) FROM c WHERE c.node = n.node AND c.m = n.node) AS itself,
  (SELECT count(*) FROM p WHERE p.node = n.node AND p.m = n.node AND p.kind = 'FILE') AS file, k.named, k.name, k.good, r.roots, r.root FROM n LEFT JOIN k ON k.node = n.node LEFT JOIN r ON r.node = n.node),
h AS (SELECT *, CASE WHEN itself > 0 THEN 'IDENTITY' WHEN candidates = 0 AND file > 0 AND kind = 'FILE' THEN 'FILE' WHEN named IS NOT NULL THEN CASE WHEN named = 1 AND good THEN 'DISCOVERY' ELSE 'INVALID' END
  WHEN roots = 1 THEN 'ROOT' WHEN candidates = 0 THEN 'MISSING' ELSE 'AMBIGUOUS' END AS how FROM f)
SELECT node, CASE WHEN how IN ('IDENTITY', 'FILE') THEN node WHEN how = 'DISCOVERY' THEN name WHEN how = 'ROOT' THEN root END AS owner, how FROM h"""
)
def architectural_owners(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("member"), (k - k % 8).alias("node"), _pick(k, "FILE", "CLASS", "METHOD", "FIELD", "ENUM", "PACKAGE", "METHOD").alias("kind"), F.when((k % 8).isin(1, 2, 5, 6), k - 1).alias("parent"))
    nodes = p.select("node").distinct().withColumn("kind", F.when(F.col("node") % 16 == 0, "FILE").otherwise("CLASS"))
    n = F.col("node")
    found = nodes.filter(n % 24 == 0).select("node", (n + 1).alias("member")).union(nodes.filter(n % 72 == 0).select("node", n + 3))
    return A.architectural_owners(nodes, p, found, p.select(F.col("member").alias("child"), "parent"))


# -- context ------------------------------------------------------------------------------------------------------

_RULES = [
    (1, "ARCH001-a", "FORBIDDEN", True, "L1", None, None, "M2"),
    (2, "ARCH002-a", "LAYER", True, "L2", None, "L3", None),
    (3, "ARCH005-a", "MODULE", True, None, "M3", None, None),
    (4, "ARCH004-a", "REVERSE", True, "L4", None, "L5", None),
    (5, "ARCH003-a", "CIRCULAR", True, None, None, None, None),
    (6, "ARCH001-b", "FORBIDDEN", False, "L1", None, "L2", None),
]
_RULE_COLUMNS = "place int, rule_id string, type string, enabled boolean, source_layer string, source_module string, target_layer string, target_module string"


@query(
    """WITH s AS (SELECT o_custkey AS context, CASE WHEN o_orderkey % 11 > 0 THEN 'L' || o_orderkey % 7 END AS layer, CASE WHEN o_orderkey % 6 > 0 THEN 'M' || o_orderkey % 5 END AS module, o_orderkey % 2 AS lc, o_orderkey % 3 AS mc FROM orders),
a AS (SELECT context, coalesce(string_agg(DISTINCT layer, ',' ORDER BY layer), '') AS layers, coalesce(string_agg(DISTINCT module, ',' ORDER BY module), '') AS modules, bool_or((layer IS NULL AND lc > 0) OR (module IS NULL AND mc > 0)) AS ambiguous,
  bool_or(layer = 'L1') OR bool_or(module = 'M2') AS r1, bool_or(layer = 'L2') AS r2, bool_or(module = 'M3') AS r3, bool_or(layer IN ('L4', 'L5')) AS r4 FROM s GROUP BY context),
f AS (SELECT a.*, x.place, x.rule_id FROM a, (VALUES (1, 'ARCH001-a'), (2, 'ARCH002-a'), (3, 'ARCH005-a'), (4, 'ARCH004-a'), (5, 'ARCH003-a')) AS x(place, rule_id)
  WHERE (place = 1 AND r1) OR (place = 2 AND r2) OR (place = 3 AND r3) OR (place = 4 AND r4) OR place = 5)
SELECT context, rule_id, 'ARC' || lpad((row_number() OVER (PARTITION BY context ORDER BY place))::VARCHAR, 3, '0') AS evidence_id, layers, modules, ambiguous FROM f"""
)
def relevant_constraints(spark, sf_dir):
    k = F.col("o_orderkey")
    chosen = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("context"), F.when(k % 11 > 0, F.concat(F.lit("L"), k % 7)).alias("layer"), F.when(k % 6 > 0, F.concat(F.lit("M"), k % 5)).alias("module"), (k % 2).alias("layer_candidates"), (k % 3).alias("module_candidates")
    )
    return A.relevant_constraints(spark.createDataFrame(_RULES, _RULE_COLUMNS), chosen)


@query(
    """WITH r AS (SELECT l_orderkey AS context, ['DEPENDENCY', 'DISCOVERY_HYPOTHESIS', 'GRAPH_METRIC'][l_linenumber % 3 + 1] AS kind, l_partkey || ':' || l_suppkey || ':' || l_linenumber AS key FROM lineitem)
SELECT context, kind, key, CASE kind WHEN 'DEPENDENCY' THEN 'DEP' WHEN 'GRAPH_METRIC' THEN 'GRAPH' ELSE 'DISC' END || lpad((row_number() OVER (PARTITION BY context, kind ORDER BY key))::VARCHAR, 3, '0') AS evidence_id FROM r"""
)
def numbered_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("context"), _pick(F.col("l_linenumber"), "DEPENDENCY", "DISCOVERY_HYPOTHESIS", "GRAPH_METRIC").alias("kind"), F.concat_ws(":", "l_partkey", "l_suppkey", "l_linenumber").alias("key")
    )
    return A.numbered_evidence(rows)


@query(
    r"""WITH a AS (SELECT doc_id AS answer, doc_id % 25 AS t, 'ARCH20' || (doc_id % 5 + 1) AS rule, doc_id % 4 AS s, doc_id % 3 AS f, text, doc_id % 13 = 0 AS twice FROM documents)
SELECT answer, CASE WHEN twice THEN 'REPEATED_KEY' WHEN n_nationkey IS NULL OR rule <> 'ARCH20' || (n_regionkey + 1) THEN 'RULE' WHEN (t + s) % 25 NOT IN (t, (t + 1) % 25, (t + 2) % 25) THEN 'SUBJECTS' WHEN f = 2 THEN 'REFERENCES'
  WHEN coalesce(regexp_matches(text, '[`{};]') OR regexp_matches(text, '(?i)\b(?:line|lines|строк[аеуи]?)\s*[:#]?\s*\d|\.(?:java|tsx?|jsx?)\b|[/\\]'), false) THEN 'LOCATION' END AS problem FROM a LEFT JOIN nation ON t = n_nationkey"""
)
def answer_problems(spark, sf_dir):
    d = F.col("doc_id")
    t = (d % 25).cast("long")
    answers = table(spark, sf_dir, "documents").select(
        d.alias("answer"), t.alias("target"), F.concat(F.lit("ARCH20"), d % 5 + 1).alias("rule"), F.array(t, (t + d % 4) % 25).alias("subjects"),
        F.array(F.concat(F.lit("DEP00"), d % 3)).alias("refs"), "text", F.when(d % 13 == 0, '{"a":1,"a":2}').otherwise('{"a":1,"b":{"a":2}}').alias("json"),
    )
    n = F.col("n_nationkey").cast("long")
    targets = table(spark, sf_dir, "nation").select(n.alias("target"), n.alias("node"), F.concat(F.lit("ARCH20"), F.col("n_regionkey") + 1).alias("rule"))
    subjects = targets.select("target", F.explode(F.array(*[(F.col("node") + i) % 25 for i in range(3)])).alias("node"))
    refs = targets.select("target", F.explode(F.array(F.lit("DEP000"), F.lit("DEP001"))).alias("ref"))
    return A.answer_problems(answers, targets, subjects, refs)


# -- cases --------------------------------------------------------------------------------------------------------

_CASES = f"""WITH a AS (SELECT 'DETERMINISTIC_CONFORMANCE' AS case_type, CASE WHEN o_orderkey % 5 = 3 THEN 'GRAPH_CONFORMANCE' ELSE 'STATIC' END AS origin, 'ARCH00' || (o_orderkey % 5) AS rule_id, 'f' || o_orderkey AS anchor,
  CASE WHEN o_orderkey % 2 = 0 THEN 'FILE' ELSE 'iam-dependency' END AS scope, list_sort(['c' || o_custkey, 'o' || o_orderkey % 9]) AS subjects FROM orders
 UNION ALL SELECT 'GRAPH_STRUCTURAL', 'GRAPH', 'ARCH101', 'g' || c_custkey, 'COMPONENT', ['c' || c_custkey] FROM customer
 UNION ALL SELECT 'SEMANTIC', 'AI', 'ARCH20' || s_nationkey % 5, 's' || s_suppkey, 'semantic-assessment', ['c' || s_suppkey] FROM supplier
 UNION ALL SELECT 'SEMANTIC', 'CALLER', q.rule_id, {_uuid("'requested-semantic-target-v1:' || q.target || ':' || q.rule_id")}, 'requested-semantic-target', [q.target]
  FROM (SELECT DISTINCT 'c' || c_custkey AS target, 'ARCH20' || c_nationkey % 5 AS rule_id FROM customer) q WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE 'c' || s_suppkey = q.target AND 'ARCH20' || s_nationkey % 5 = q.rule_id)),
i AS (SELECT *, 'hybrid-case-v1:' || case_type || ':' || origin || ':' || rule_id || ':' || anchor || ':' || scope || ':' || array_to_string(subjects, ':') AS name FROM a),
c AS (SELECT *, {_uuid("name")} AS case_id FROM i)
"""


def _cases(spark, sf_dir):
    c = lambda col: F.concat(F.lit("c"), col)
    o = F.col("o_orderkey")
    findings = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("f"), o).alias("id"), F.concat(F.lit("ARCH00"), o % 5).alias("rule_id"), F.array(F.concat(F.lit("o"), o % 9), c(F.col("o_custkey"))).alias("subjects"), F.when(o % 2 == 0, "FILE").alias("scope")
    )
    customer, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    found = customer.select(F.concat(F.lit("g"), k).alias("id"), F.lit("ARCH101").alias("rule_id"), F.array(c(k)).alias("subjects"), F.lit("COMPONENT").alias("scope"))
    s = F.col("s_suppkey")
    rule = lambda n: F.concat(F.lit("ARCH20"), F.col(n) % 5).alias("rule_id")
    said = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), s).alias("id"), rule("s_nationkey"), F.array(c(s)).alias("subjects"), c(s).alias("target"))
    return A.cases(SPACE, findings, found, said, customer.select(c(k).alias("target"), rule("c_nationkey")))


@query(_CASES + f"SELECT case_id, {_uuid(chr(39) + 'evidence-bundle-v1' + chr(39), 'case_id')} AS bundle_id, case_type, origin, rule_id, anchor, scope, array_to_string(subjects, ',') AS subjects FROM c")
def hybrid_cases(spark, sf_dir):
    return _cases(spark, sf_dir).withColumn("subjects", F.array_join("subjects", ","))


@query(
    """WITH e AS (SELECT p_partkey AS edge, p_partkey % 5 AS src, p_size % 5 AS dst FROM part),
r AS (SELECT l_orderkey AS finding, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS seq, l_partkey AS edge, l_partkey % 5 AS source, CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey % 5 ELSE dst END AS target, dst FROM lineitem JOIN e ON l_partkey = edge),
g AS (SELECT *, lead(source) OVER (PARTITION BY finding ORDER BY seq) <> target AS gap FROM r),
p AS (SELECT finding, count(*) AS records, count(*) FILTER (target <> dst) AS unmatched, NOT bool_or(coalesce(gap, false)) AND arg_min(source, seq) = arg_max(target, seq) AS closed FROM g GROUP BY finding),
f AS (SELECT o_orderkey AS finding, 'ARCH00' || (o_orderkey % 4 + 1) AS rule_id, CASE WHEN o_custkey % 9 > 0 THEN 'spec' END AS spec FROM orders)
SELECT f.finding, coalesce(records, 0)::BIGINT AS records, coalesce(unmatched, 0)::BIGINT AS unmatched, coalesce(closed, false) AS closed, spec IS NOT NULL AND coalesce(unmatched, 0) = 0 AND (rule_id <> 'ARCH003' OR coalesce(closed, false)) AS valid FROM f LEFT JOIN p USING (finding)"""
)
def checked_proofs(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("edge"), (F.col("p_partkey") % 5).alias("src"), (F.col("p_size") % 5).cast("long").alias("dst"), F.lit("CALLS").alias("kind"))
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "edge").join(part, "edge")
    records = items.select(F.col("l_orderkey").alias("finding"), (F.col("l_linenumber") * F.lit(10**12) + F.col("edge") * 1_000_000 + F.col("l_suppkey")).alias("seq"), "edge", F.col("src").alias("source"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey") % 5).otherwise(F.col("dst")).alias("target"), F.col("kind").alias("relation"))
    o = F.col("o_orderkey")
    findings = table(spark, sf_dir, "orders").select(o.alias("finding"), F.concat(F.lit("ARCH00"), o % 4 + 1).alias("rule_id"), F.when(F.col("o_custkey") % 9 > 0, "spec").alias("specification"))
    return A.checked_proofs(findings, records, part, "spec")


_EVIDENCE = """WITH e AS (SELECT o_custkey AS case_id, ['graph', 'ai', 'discovery'][o_orderkey % 3 + 1] AS channel, 'r' || o_orderkey AS ref, ['SUPPORTING', 'CONTRADICTING', 'NEUTRAL', 'MISSING'][o_orderkey // 3 % 4 + 1] AS agreement FROM orders),
a AS (SELECT e.* FROM e JOIN customer ON case_id = c_custkey UNION ALL SELECT c_custkey, ch, 'missing:' || ch, 'MISSING' FROM customer, (VALUES ('graph'), ('ai'), ('discovery')) AS x(ch) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.case_id = c_custkey AND e.channel = ch)),
b AS (SELECT case_id, coalesce(string_agg(ref, ',' ORDER BY ref) FILTER (channel = 'ai' AND agreement <> 'MISSING'), '') AS ai, coalesce(string_agg(ref, ',' ORDER BY ref) FILTER (channel = 'graph' AND agreement <> 'MISSING'), '') AS graph,
  coalesce(string_agg(ref, ',' ORDER BY ref) FILTER (channel = 'discovery' AND agreement <> 'MISSING'), '') AS discovery, count(*) FILTER (agreement = 'SUPPORTING')::BIGINT AS supporting, count(*) FILTER (agreement = 'CONTRADICTING')::BIGINT AS contradicting, count(*) FILTER (agreement = 'MISSING')::BIGINT AS missing FROM a GROUP BY case_id)
"""


def _bundles(spark, sf_dir):
    o = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("case_id"), _pick(o, "graph", "ai", "discovery").alias("channel"), F.concat(F.lit("r"), o).alias("ref"), F.lit("EXACT_SUBJECT").alias("method"), _pick(F.floor(o / 3), "SUPPORTING", "CONTRADICTING", "NEUTRAL", "MISSING").alias("agreement"), F.lit("x").alias("reason")
    )
    return A.bundles(A.alignments(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id")), e))


@query(_EVIDENCE + "SELECT * FROM b")
def evidence_bundles(spark, sf_dir):
    out = _bundles(spark, sf_dir)
    return out.select("case_id", *[F.array_join(c, ",").alias(c) for c in ("ai", "graph", "discovery")], "supporting", "contradicting", "missing")


@query(
    _EVIDENCE
    + """, s AS (SELECT c_mktsegment AS case_type, CASE WHEN c_custkey % 3 = 0 THEN 'REVIEW' ELSE 'INSUFFICIENT' END AS state, b.* FROM b JOIN customer ON case_id = c_custkey)
SELECT CASE WHEN grouping(case_type) = 0 THEN 'case_type' WHEN grouping(state) = 0 THEN 'state' ELSE 'total' END AS dimension, coalesce(case_type, state, '*') AS value, count(*)::BIGINT AS cases, sum(supporting)::BIGINT AS supporting, sum(contradicting)::BIGINT AS contradicting, sum(missing)::BIGINT AS missing
FROM s GROUP BY GROUPING SETS ((case_type), (state), ())"""
)
def hybrid_statistics(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("case_type"), F.when(F.col("c_custkey") % 3 == 0, "REVIEW").otherwise("INSUFFICIENT").alias("state"))
    return A.hybrid_statistics(_bundles(spark, sf_dir).join(c, "case_id"))


# -- predictions and mutations ----------------------------------------------------------------------------------------

_PREDICTED = f"""WITH p AS (SELECT 'ARCH00' || (1 + l_partkey % 2) AS rule_id, ['p' || l_partkey, 's' || l_suppkey] AS subjects, true AS directed, 'POSITIVE' AS state, 'STATIC_ONLY' AS source, 'CONFIRMED_VIOLATION_DETECTION' AS task, l_orderkey || '-' || l_linenumber AS origin FROM lineitem
 UNION ALL SELECT 'ARCH104', CASE WHEN o_orderkey % 2 = 0 THEN ['o' || o_orderkey, 'c' || o_custkey] ELSE ['o' || o_orderkey] END, o_orderkey % 2 = 0, 'CANDIDATE', 'GRAPH_ONLY', 'STRUCTURAL_SIGNAL_RETRIEVAL', o_orderkey::VARCHAR FROM orders
 UNION ALL SELECT 'ARCH20' || s_nationkey % 5, list_sort(['s' || s_suppkey, 'n' || s_nationkey]), false, ['CANDIDATE', 'NEGATIVE', 'ABSTAIN'][s_suppkey % 3 + 1], 'LLM_ONLY', 'SEMANTIC_CANDIDATE_DETECTION', s_suppkey::VARCHAR FROM supplier
 UNION ALL SELECT 'ARCH00' || (c_custkey % 5 + 1), CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 2 THEN CASE WHEN c_custkey % 5 IN (0, 1, 3, 4) THEN ['b' || c_custkey, 'a' || c_custkey] ELSE ['a' || c_custkey, 'b' || c_custkey] END
   WHEN c_custkey % 5 = 2 THEN ['w', 'x' || c_custkey] ELSE ['x' || c_custkey, 'w'] END, c_custkey % 5 <> 2, 'POSITIVE', 'HYBRID', 'CONFIRMED_VIOLATION_DETECTION', c_custkey::VARCHAR FROM customer WHERE c_custkey % 3 = 1),
k AS (SELECT *, '["' || directed || '","' || array_to_string(subjects, '|') || '"]' AS subject_key FROM p)
SELECT {_uuid("'repo:' || rule_id || ':' || subject_key || ':' || source || ':' || task || ':' || state")} AS prediction_id, 'repo' AS repository_id, rule_id, subject_key, state, source, task, origin FROM k"""


@query(_PREDICTED)
def prediction_rows(spark, sf_dir):
    a = lambda p, c: F.concat(F.lit(p), c)
    items = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("finding"), a("ARCH00", 1 + F.col("l_partkey") % 2).alias("rule_id"), a("p", F.col("l_partkey")).alias("source"), a("s", F.col("l_suppkey")).alias("target"))
    o = F.col("o_orderkey")
    signals = table(spark, sf_dir, "orders").select(o.alias("candidate"), F.lit("ARCH104").alias("rule_id"), a("o", o).alias("subject"), F.when(o % 2 == 0, a("c", F.col("o_custkey"))).alias("object"))
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    said = table(spark, sf_dir, "supplier").select(s.alias("candidate"), a("ARCH20", n % 5).alias("rule_id"), F.array(a("s", s), a("n", n)).alias("subjects"), _pick(s, "SUPPORTED", "NOT_SUPPORTED", "INSUFFICIENT_CONTEXT").alias("decision"))
    asked = said.select("rule_id", F.get("subjects", 0).alias("node"))
    c = F.col("c_custkey")
    decided = table(spark, sf_dir, "customer").select(
        c.alias("anchor"), a("ARCH00", c % 5 + 1).alias("rule_id"), F.array(a("x", c), F.lit("w")).alias("subjects"), F.when(c % 2 == 0, a("b", c)).alias("pair_source"), F.when(c % 2 == 0, a("a", c)).alias("pair_target"), F.when(c % 3 == 1, "CONFIRMED_DETERMINISTIC").otherwise("REVIEW").alias("state")
    )
    out = P.static_predictions(items, SPACE, "repo").union(P.graph_predictions(signals, SPACE, "repo"))
    return out.union(P.semantic_predictions(said, asked, SPACE, "repo")).union(P.hybrid_predictions(decided, SPACE, "repo"))


@query(
    """WITH m AS (SELECT page_id AS mutation, page_id % 2 = 0 AS java, CASE WHEN page_id % 2 = 0 THEN 'src/app/F' || page_id || '.java' ELSE 'src/app/F' || page_id || '.ts' END AS path,
  'class F' || page_id || ' { ' || CASE WHEN page_id % 7 = 0 THEN '' ELSE '// BENCHMARK_DEPENDENCIES' END || ' }' || chr(10) AS text FROM pages)
SELECT mutation, path, CASE WHEN mutation % 7 = 0 OR mutation % 11 = 0 THEN NULL WHEN java THEN replace(text, '// BENCHMARK_DEPENDENCIES', 'shop.core.Target benchmarkDependency;')
  ELSE 'import { Target } from ''' || CASE WHEN mutation % 3 = 0 THEN './Target' ELSE '../core/lib/Target' END || ''';' || chr(10) || replace(text, '// BENCHMARK_DEPENDENCIES', 'benchmarkDependency!: Target;') END AS text,
 CASE WHEN mutation % 11 = 0 THEN 'ENDPOINT' WHEN mutation % 7 = 0 THEN 'MARKER' END AS problem FROM m"""
)
def mutated_sources(spark, sf_dir):
    k = F.col("page_id")
    java = k % 2 == 0
    rows = table(spark, sf_dir, "pages").select(k, java.alias("java"), F.concat(F.lit("src/app/F"), k, F.when(java, ".java").otherwise(".ts")).alias("path"), F.concat(F.lit("class F"), k, F.lit(" { "), F.when(k % 7 == 0, "").otherwise(P.MARKER), F.lit(" }\n")).alias("text"))
    files = rows.select("path", "text").union(spark.createDataFrame([("src/app/Target.ts", ""), ("src/core/lib/Target.ts", ""), ("src/core/Target.java", "")], "path string, text string"))
    target = F.when(k % 11 == 0, "none.ts").when(F.col("java"), "src/core/Target.java").when(k % 3 == 0, "src/app/Target.ts").otherwise("src/core/lib/Target.ts")
    mutations = rows.select(k.alias("mutation"), F.col("path").alias("source_path"), target.alias("target_path"), F.when(F.col("java"), "JAVA").otherwise("TYPESCRIPT").alias("language"), F.when(F.col("java"), "shop.core.Target").otherwise("mod::Target").alias("target_name"))
    return P.mutated(files, mutations)


@query(
    f"""WITH m AS (SELECT o_orderkey AS mutation, 'a' || o_custkey AS s, 'b' || o_orderkey % 50 AS t FROM orders), e AS (SELECT l_orderkey AS mutation FROM lineitem GROUP BY ALL HAVING min(l_linenumber) = 1 AND max(l_quantity) > 40)
SELECT mutation, e.mutation IS NOT NULL AS verified, {_uuid("'repo:ARCH001:POSITIVE:[" + '"true","' + "' || s || '|' || t || '" + '"]' + "'")} AS case_id FROM m LEFT JOIN e USING (mutation)"""
)
def mutation_truth(spark, sf_dir):
    o = F.col("o_orderkey")
    m = table(spark, sf_dir, "orders").select(o.alias("mutation"), F.concat(F.lit("a"), "o_custkey").alias("source_path"), F.concat(F.lit("b"), o % 50).alias("target_path"))
    kept = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mutation")).agg(F.min("l_linenumber").alias("a"), F.max("l_quantity").alias("b")).filter("a = 1 and b > 40")
    edges = m.join(kept, "mutation").select("mutation", F.col("source_path").alias("src_path"), F.col("target_path").alias("dst_path"))
    truth = P.expected_truth(m, SPACE, "repo", "ARCH001").select("mutation", "case_id")
    return P.verified(m, edges, "ARCH001").join(truth, "mutation")


# -- security across functions ----------------------------------------------------------------------------------------

_CALLS = "SELECT s_suppkey AS caller, s_suppkey * 3 % (SELECT count(*) FROM supplier) + 1 AS callee FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT s_suppkey, s_suppkey * 7 % (SELECT count(*) FROM supplier) + 1 FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 17 = 0"


@query(
    f"""WITH RECURSIVE c AS ({_CALLS}), f AS (SELECT s_suppkey AS f, s_suppkey % 19 = 0 AS unknown, s_suppkey % 7 = 0 AS tainted FROM supplier),
w AS (SELECT f AS root, f AS here, [f] AS path, 'RUN' AS what FROM f UNION ALL SELECT root, callee, list_append(path, callee), CASE WHEN list_contains(path, callee) THEN 'RECURSION' WHEN len(path) >= 4 THEN 'DEPTH' ELSE 'RUN' END FROM w JOIN c ON here = caller WHERE what = 'RUN'),
g AS (SELECT root, count(*) FILTER (what = 'RUN') AS n, bool_or(what = 'DEPTH') AS d, bool_or(what = 'RECURSION') AS r, bool_or(what = 'RUN' AND unknown) AS u, bool_or(what = 'RUN' AND tainted) AS t FROM w JOIN f ON here = f.f GROUP BY root)
SELECT root, n::BIGINT AS expansions, d AS depth_limit, r AS recursion, false AS expansion_limit, CASE WHEN d OR r OR u THEN 'UNKNOWN' WHEN t THEN 'TAINTED' ELSE 'UNTAINTED' END AS state FROM g"""
)
def call_summaries(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    n = F.broadcast(supplier.agg(F.count(F.lit(1)).alias("n")))
    s = F.col("s_suppkey")
    rows = supplier.join(n, F.lit(True))
    calls = rows.filter(s % 3 > 0).select(s.alias("caller"), (s * 3 % F.col("n") + 1).alias("callee"))
    calls = calls.union(rows.filter(s % 5 == 0).select(s, s * 7 % F.col("n") + 1)).union(rows.filter(s % 17 == 0).select(s, s))
    state = F.when(s % 19 == 0, "UNKNOWN").when(s % 7 == 0, "TAINTED").otherwise("UNTAINTED")
    return X.call_summaries(calls, supplier.select(s.alias("function"), state.alias("state")))


@query(
    """WITH v AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 4 > 0 THEN 'o' || o_custkey % 3 END AS object_id, CASE WHEN o_orderkey % 2 = 0 THEN 'p' || o_custkey END AS path_fact, CASE WHEN o_custkey % 5 > 0 THEN 'u' || o_custkey END AS url_id,
  CASE WHEN o_custkey % 5 > 0 THEN CASE WHEN o_custkey % 2 = 0 OR o_orderkey % 3 > 0 THEN 'host' ELSE 'path' END END AS url_part, o_orderkey % 29 = 0 AS u FROM orders)
SELECT k, CASE WHEN count(DISTINCT coalesce(object_id, '-')) = 1 THEN min(object_id) END AS object_id, CASE WHEN count(DISTINCT coalesce(path_fact, '-')) = 1 THEN min(path_fact) END AS path_fact,
 CASE WHEN count(DISTINCT (coalesce(url_id, '-') || '|' || coalesce(url_part, '-'))) = 1 THEN min(url_id) END AS url_id, CASE WHEN count(DISTINCT (coalesce(url_id, '-') || '|' || coalesce(url_part, '-'))) = 1 THEN min(url_part) END AS url_part, bool_or(u) AS unknown FROM v GROUP BY k"""
)
def joined_values(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    url = c % 5 > 0
    values = table(spark, sf_dir, "orders").select(
        c.alias("k"), F.when(c % 4 > 0, F.concat(F.lit("o"), c % 3)).alias("object_id"), F.when(o % 2 == 0, F.concat(F.lit("p"), c)).alias("path_fact"), F.when(url, F.concat(F.lit("u"), c)).alias("url_id"),
        F.when(url, F.when((c % 2 == 0) | (o % 3 > 0), "host").otherwise("path")).alias("url_part"), F.when(o % 29 == 0, "UNKNOWN").otherwise("TAINTED").alias("state"),
    )
    return X.joined_values(values, "k")


@query(
    """WITH g AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'JAVA' ELSE 'TYPESCRIPT' END AS language, ['startsWith', 'equals', 'includes', '!==', 'endsWith'][event_id % 5 + 1] AS call, event_id % 3 > 0 AS normalized, event_id % 4 > 0 AS is_root, CASE WHEN event_id % 7 > 0 THEN '/srv' ELSE '/tmp' END AS proot,
  CASE WHEN event_id % 11 > 0 THEN '/srv/' ELSE '/srv' END AS prefix, CASE WHEN event_id % 6 > 0 THEN 'host' WHEN event_id % 12 = 0 THEN 'path' END AS part, event_id % 13 = 0 AS none, event_id % 17 = 0 AS odd, event_id % 19 < 9 AS negated FROM events),
p AS (SELECT *, CASE WHEN call = 'startsWith' AND normalized AND CASE WHEN language = 'JAVA' THEN is_root AND proot = '/srv' ELSE prefix = '/srv/' END THEN 'PATH_CONFINEMENT'
  WHEN call IN ('equals', 'includes', '!==') AND coalesce(part = 'host', false) AND NOT none AND NOT odd THEN 'SSRF_ALLOWLIST' END AS proof FROM g)
SELECT event_id, proof, CASE WHEN proof IS NULL AND call = 'startsWith' THEN 'CONFINEMENT_UNPROVEN' WHEN proof IS NULL AND call IN ('equals', 'includes') AND part IS NOT NULL THEN 'ALLOWLIST_UNPROVEN' END AS doubt,
 CASE WHEN proof IS NOT NULL THEN CASE WHEN negated <> (call = '!==') THEN 'ELSE' ELSE 'THEN' END END AS branch, CASE proof WHEN 'PATH_CONFINEMENT' THEN 'SEC004' WHEN 'SSRF_ALLOWLIST' THEN 'SEC006' END AS rule_id FROM p"""
)
def guard_proofs(spark, sf_dir):
    e = F.col("event_id")
    call = _pick(e, "startsWith", "equals", "includes", "!==", "endsWith")
    part = F.when(e % 6 > 0, "host").when(e % 12 == 0, "path")
    hosts = F.when(e % 13 == 0, F.array().cast("array<string>")).when(e % 17 == 0, F.array(F.lit("api.example.org"), F.lit("evil/../x"))).otherwise(F.array(F.lit("api.example.org")))
    language = F.when(F.col("user_id") % 2 == 0, "JAVA").otherwise("TYPESCRIPT")
    proof = X.guard_proof(language, call, e % 3 > 0, F.lit("/srv"), e % 4 > 0, F.when(e % 7 > 0, "/srv").otherwise("/tmp"), F.when(e % 11 > 0, "/srv/").otherwise("/srv"), part, hosts)
    rows = table(spark, sf_dir, "events").select(e, call.alias("call"), proof.alias("proof"), part.isNotNull().alias("has_url"), (e % 19 < 9).alias("negated"))
    p = F.col("proof")
    return rows.select("event_id", "proof", X.guard_doubt(F.col("call"), p, F.col("has_url")).alias("doubt"), X.proven_branch(F.col("call"), F.col("negated"), p).alias("branch"), X.proof_rule(p).alias("rule_id"))


@query(
    """WITH n AS (SELECT event_id, ['String', 'java.util.List', 'javax.script.ScriptEngine', 'Helper', 'java.', 'Long'][event_id % 6 + 1] AS name, ['String', 'java', 'x'][user_id % 3 + 1] AS bound, user_id % 5 = 0 AS imported FROM events)
SELECT event_id, CASE WHEN name IN ('String', 'Long') AND name <> bound AND NOT imported THEN 'java.lang.' || name WHEN name IN ('java.util.List', 'javax.script.ScriptEngine') AND str_split(name, '.')[1] <> bound THEN name END AS qualified FROM n"""
)
def qualified_names(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    name = _pick(e, "String", "java.util.List", "javax.script.ScriptEngine", "Helper", "java.", "Long")
    return table(spark, sf_dir, "events").select("event_id", X.qualified_java(name, F.array(_pick(u, "String", "java", "x")), u % 5 == 0).alias("qualified"))


@query(
    """WITH f AS (SELECT page_id, page_id % 2 = 0 AS hash, ['sha256', 'SHA512', 'md5', 'aes-256-gcm'][page_id % 4 + 1] AS a, page_id % 5 > 0 AS same, page_id % 7 > 0 AS alone, page_id % 11 = 0 AS blocked FROM pages)
SELECT page_id, CASE WHEN same AND alone AND NOT blocked AND CASE WHEN hash THEN a = 'sha256' ELSE a = 'aes-256-gcm' END THEN 'COMPLETE' ELSE 'NOT_PROVEN' END AS status,
 CASE WHEN same AND alone AND NOT blocked AND CASE WHEN hash THEN a = 'sha256' ELSE a = 'aes-256-gcm' END THEN 'CLOSED_LITERAL_CRYPTO_SCOPE' WHEN blocked THEN 'CALL_DEPTH_LIMIT' ELSE 'COMPLETENESS_NOT_PROVEN' END AS reasons FROM f"""
)
def completeness_certificates(spark, sf_dir):
    k = F.col("page_id")
    call = F.when(k % 2 == 0, F.concat(F.lit("createHash('"), _pick(k, "sha256", "SHA512", "md5", "aes-256-gcm"), F.lit("')"))).otherwise(F.concat(F.lit('createCipheriv("'), _pick(k, "sha256", "SHA512", "md5", "aes-256-gcm"), F.lit("\", 'key', 'iv')")))
    text = F.concat(F.lit("import c from 'node:crypto';\n"), F.when(k % 5 > 0, "c").otherwise("d"), F.lit("."), call, F.lit(";"), F.when(k % 7 > 0, "\n").otherwise("\nrun();\n"))
    blocked = F.when(k % 11 == 0, F.array(F.lit("CALL_DEPTH_LIMIT"))).otherwise(F.array().cast("array<string>"))
    status = X.certificate(F.lit("TYPESCRIPT"), F.lit("SEC008"), F.lit(1), F.col("text"), F.col("blocked"), F.lit(False))
    rows = table(spark, sf_dir, "pages").select("page_id", text.alias("text"), blocked.alias("blocked")).withColumn("status", status)
    return rows.select("page_id", "status", F.array_join(X.certificate_reasons(F.col("status"), F.col("blocked")), ",").alias("reasons"))


@query(
    """WITH RECURSIVE p AS (SELECT p_partkey AS scope, CASE WHEN p_partkey >= 4 THEN p_partkey // 4 END AS parent FROM part), s AS (SELECT p_partkey AS scope, p_brand AS name FROM part WHERE p_size % 5 = 0 UNION ALL SELECT NULL, 'Brand#11'),
r AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS ref, p_brand AS name, l_suppkey + l_linenumber * 37 AS scope FROM lineitem JOIN part ON l_partkey = p_partkey),
u AS (SELECT scope, scope AS at FROM p UNION SELECT u.scope, p.parent FROM u JOIN p ON p.scope = u.at WHERE p.parent IS NOT NULL), b AS (SELECT DISTINCT u.scope, s.name FROM u JOIN s ON s.scope = u.at)
SELECT ref, r.name, r.scope, r.name = 'Brand#11' OR b.name IS NOT NULL AS is_shadowed FROM r LEFT JOIN b ON b.scope = r.scope AND b.name = r.name"""
)
def shadowed_names(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    containers = part.select(k.alias("scope"), F.when(k >= 4, F.floor(k / 4)).alias("parent"))
    shadows = part.filter("p_size % 5 = 0").select(k.alias("scope"), F.col("p_brand").alias("name")).union(spark.createDataFrame([(None, "Brand#11")], "scope long, name string"))
    items = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == k)
    refs = items.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ref"), F.col("p_brand").alias("name"), (F.col("l_suppkey") + F.col("l_linenumber") * 37).alias("scope"))
    return R.shadowed(refs, shadows, containers)


# -- intake -------------------------------------------------------------------------------------------------------


@query(
    r"""WITH p AS (SELECT page_id, ['src/app/', 'src/app/keep/', 'lib/', 'docs/build/', ''][page_id % 5 + 1] || ['a', 'tmp_x', 'b'][page_id % 3 + 1] || page_id || ['.log', '.ts', '.md'][page_id // 3 % 3 + 1] AS path, page_id % 5 AS d, page_id % 3 AS n, page_id // 3 % 3 AS e FROM pages)
SELECT page_id, path, CASE WHEN d = 3 THEN 'DEFAULT' WHEN e = 2 THEN 'CUSTOM' WHEN CASE WHEN d = 1 THEN n = 1 WHEN d = 0 AND n = 1 THEN true ELSE e = 0 END THEN 'GITIGNORE' END AS reason FROM p"""
)
def ignored_files(spark, sf_dir):
    k = F.col("page_id")
    path = F.concat(_pick(k, "src/app/", "src/app/keep/", "lib/", "docs/build/", ""), _pick(k, "a", "tmp_x", "b"), k, _pick(F.floor(k / 3), ".log", ".ts", ".md"))
    scopes = {"": ["# logs", "*.log"], "src/app": ["tmp_*"], "src/app/keep": ["!*.log", "tmp_*"]}
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.withColumn("reason", I.excluded_by(F.col("path"), ["**/*.md"], scopes))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'BINARY' WHEN page_id % 3 = 0 THEN 'TEST' ELSE 'SOURCE' END AS kind FROM pages""")
def content_classification(spark, sf_dir):
    k = F.col("page_id")
    path = F.concat(F.when(k % 3 == 0, "src/tests/").otherwise("src/main/"), k, F.lit(".java"))
    content = F.concat(F.when(k % 4 == 0, F.unhex(F.lit("4100"))).otherwise(F.unhex(F.lit("41"))), F.encode("html", "UTF-8"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), content.alias("content"))
    return I.classified(rows, content="content").select("page_id", "kind")


# -- single checks ------------------------------------------------------------------------------------------------


@query(""", v AS (SELECT count(DISTINCT user_id) AS n FROM events), e AS (SELECT count(*) AS n FROM follow) SELECT 'more than 100 nodes' AS problem FROM v WHERE n > 100 UNION ALL SELECT 'more than 1000 edges' FROM e WHERE n > 1000""", "follow")
def graph_limits(spark, sf_dir):
    found = G.guard(relation(spark, sf_dir, "user_vertex"), relation(spark, sf_dir, "follow"), 100, 1_000)
    return spark.createDataFrame([(x,) for x in found], "problem string")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'INVALID' WHEN o_custkey % 3 > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status FROM orders""")
def analysis_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", G.analysis_status(F.col("o_orderkey") % 97 == 0, F.col("o_custkey") % 3).alias("status"))


@query("""SELECT l_partkey AS src, l_suppkey AS dst, count(*)::BIGINT AS proofs FROM lineitem GROUP BY ALL HAVING bool_or(l_returnflag IN ('A', 'R'))""")
def edges_with_proof(spark, sf_dir):
    proofs = F.collect_list(F.struct(F.col("l_returnflag").alias("relation"))).alias("proofs")
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(proofs)
    return G.with_proof_in(edges, ("A", "R")).withColumn("proofs", F.size("proofs").cast("long"))


@query(
    """WITH n AS (SELECT 'n' || p_partkey AS node, p_name AS name, p_brand || '.' || p_name AS q, CASE WHEN p_partkey % 9 = 0 THEN 'PACKAGE' ELSE 'CLASS' END AS kind FROM part),
k AS (SELECT DISTINCT unnest([node, name, q]) AS name, node FROM n WHERE kind = 'CLASS'), r AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT 'n' || l_suppkey FROM lineitem UNION SELECT DISTINCT p_brand || '.' || p_name FROM part),
c AS (SELECT r.name, count(DISTINCT node) AS n, min(node) AS one FROM r LEFT JOIN k USING (name) GROUP BY r.name)
SELECT name, n::BIGINT AS candidates, CASE WHEN n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS status, CASE WHEN n = 1 THEN one END AS target FROM c"""
)
def named_nodes(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    full = F.concat_ws(".", "p_brand", "p_name")
    nodes = part.select(F.concat(F.lit("n"), k).alias("node"), F.col("p_name").alias("name"), full.alias("qualified_name"), F.when(k % 9 == 0, "PACKAGE").otherwise("CLASS").alias("kind"))
    names = part.select(F.col("p_name").alias("name")).union(table(spark, sf_dir, "lineitem").select(F.concat(F.lit("n"), "l_suppkey"))).union(part.select(full)).distinct()
    return R.by_name(names, nodes)


@query("""SELECT count(*)::BIGINT AS subjects, count(lang)::BIGINT AS with_role, count(*) FILTER (doc_id % 3 > 0)::BIGINT AS with_layer, round(count(lang) / count(*)::DOUBLE, 12) AS role_coverage, round(count(*) FILTER (doc_id % 3 > 0) / count(*)::DOUBLE, 12) AS layer_coverage FROM documents""")
def discovery_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("subject"), F.col("lang").alias("role"), F.when(F.col("doc_id") % 3 > 0, "CORE").otherwise("UNKNOWN").alias("layer"))
    return D.coverage(rows).withColumns({c: F.round(c, 12) for c in ("role_coverage", "layer_coverage")})


@query(
    """WITH f AS (SELECT l_orderkey AS finding_id, l_returnflag AS a, CASE WHEN l_orderkey % 2 = 0 THEN 'x' ELSE l_linestatus END AS b FROM lineitem),
g AS (SELECT finding_id, count(DISTINCT a || '|' || b) AS n, min(a || '|' || b) AS one FROM f GROUP BY finding_id)
SELECT finding_id, n > 1 AS conflict, CASE WHEN n = 1 THEN one END AS content FROM g"""
)
def finding_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), F.col("l_returnflag").alias("a"), F.when(F.col("l_orderkey") % 2 == 0, "x").otherwise(F.col("l_linestatus")).alias("b"))
    good, bad = S.distinct_findings(rows)
    return good.select("finding_id", F.lit(False).alias("conflict"), F.concat_ws("|", "a", "b").alias("content")).union(bad.select("finding_id", F.lit(True), F.lit(None).cast("string")))
