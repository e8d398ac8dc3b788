"""Queries of conformance, graph analytics and discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.globs import glob_regex
from plumbline.operators import conformance as C
from plumbline.operators import discovery as D
from plumbline.operators import graph as G

from .adapters import oracle, part, relation, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, *names: str, recursive: bool = False):
    """Registers a query under its function's name, with its oracle over the named relations."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql, *names, recursive=recursive)
        return f

    return add


LAYER_RULES = (
    C.Rule("L1", "layer", "ASIA", allow=("EUROPE",), severity="HIGH"),
    C.Rule("F1", "forbidden", "AFRICA", "AMERICA", relations=("CALLS", "USES"), severity="LOW"),
    C.Rule("R1", "reverse", "EUROPE", "MIDDLE EAST", severity="MEDIUM"),
    C.Rule("B1", "boundary", "core", deny=("edge",), relations=("IMPORTS",), severity="HIGH"),
)
_LABELLED = """, l AS (SELECT dep.*, a.layer AS src_layer, b.layer AS dst_layer, a.module AS src_module, b.module AS dst_module
  FROM dep JOIN component a ON src = a.v JOIN component b ON dst = b.v),
h AS (SELECT 'L1' AS rule_id, 'HIGH' AS severity, * FROM l WHERE src_layer = 'ASIA' AND dst_layer <> 'ASIA' AND dst_layer <> 'EUROPE'
  UNION ALL SELECT 'F1', 'LOW', * FROM l WHERE src_layer = 'AFRICA' AND dst_layer = 'AMERICA' AND relation IN ('CALLS', 'USES')
  UNION ALL SELECT 'R1', 'MEDIUM', * FROM l WHERE src_layer = 'MIDDLE EAST' AND dst_layer = 'EUROPE'
  UNION ALL SELECT 'B1', 'HIGH', * FROM l WHERE src_module = 'core' AND dst_module = 'edge' AND relation = 'IMPORTS'),
f AS (SELECT rule_id, severity, src AS source, dst AS target, sum(occurrences)::BIGINT AS occurrences,
  string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM h GROUP BY ALL)
"""


def _deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies with the layers and modules of both ends; components are few and of fixed number here."""
    c = relation(spark, sf_dir, "component")
    ends = [c.select(F.col("v").alias(e), F.col("layer").alias(f"{e}_layer"), F.col("module").alias(f"{e}_module")) for e in ("src", "dst")]
    return relation(spark, sf_dir, "dep").join(ends[0], "src").join(ends[1], "dst")


def _findings(spark, sf_dir):
    return C.findings(C.violations(_deps(spark, sf_dir), LAYER_RULES))


@query(_LABELLED + "SELECT * FROM f", "dep", "component")
def rule_findings(spark, sf_dir):
    return _findings(spark, sf_dir).drop("finding_id")


@query(
    _LABELLED
    + """SELECT rule_id, source, target, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
  || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS finding_id
FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('["' || rule_id || '","' || source || '","' || target || '"]')) AS h FROM f)""",
    "dep",
    "component",
)
def finding_ids(spark, sf_dir):
    return _findings(spark, sf_dir).select("rule_id", "source", "target", "finding_id")


@query(
    _LABELLED
    + """SELECT CASE WHEN grouping(severity) = 1 AND grouping(rule_id) = 0 THEN 'rule' WHEN grouping(severity) = 0 THEN 'severity' ELSE 'total' END AS dimension,
  coalesce(rule_id, severity, '*') AS value, count(*)::BIGINT AS findings, sum(occurrences)::BIGINT AS occurrences
FROM f GROUP BY GROUPING SETS ((rule_id), (severity), ())""",
    "dep",
    "component",
)
def check_summary(spark, sf_dir):
    return C.summary(_findings(spark, sf_dir))


@query(
    _LABELLED
    + """SELECT module, CASE WHEN n > 0 THEN 'NON_CONFORMANT' ELSE 'CONFORMANT' END AS status, n AS findings FROM
(SELECT c.module, count(f.source)::BIGINT AS n FROM component c LEFT JOIN f ON f.source = c.v GROUP BY c.module)""",
    "dep",
    "component",
)
def conformance_status(spark, sf_dir):
    rows = relation(spark, sf_dir, "component").join(_findings(spark, sf_dir).withColumnRenamed("source", "v"), "v", "left")
    rows = rows.groupBy("module").agg(F.count("target").alias("findings"))
    return rows.select("module", C.status(F.lit(False), F.col("findings"), F.lit(False)).alias("status"), "findings")


SCOPES = (
    C.Scope("layer", "english", ("en/**",), ("en/1*",)),
    C.Scope("layer", "numbered", ("*/[0-9][0-9]", "**/*.html")),
    C.Scope("module", "continental", ("fr/**", "de/**", "es/**")),
)
_SCOPE = " ".join(
    f"CASE WHEN ({' OR '.join(f'''regexp_matches(path, '{glob_regex(g)}')''' for g in s.include)})"
    f" AND NOT ({' OR '.join(f'''regexp_matches(path, '{glob_regex(g)}')''' for g in s.exclude) or 'false'}) THEN '{s.name}' END AS {s.name},"
    for s in SCOPES
)


@query(
    f""", m AS (SELECT page_id, {_SCOPE} 0 AS z FROM file)
SELECT page_id, CASE WHEN (english IS NULL) <> (numbered IS NULL) THEN coalesce(english, numbered) END AS layer, continental AS module,
  concat_ws(',', english, numbered) AS layer_candidates, coalesce(continental, '') AS module_candidates,
  CASE WHEN english IS NOT NULL AND numbered IS NOT NULL THEN 'AMBIGUOUS' WHEN coalesce(english, numbered, continental) IS NOT NULL THEN 'CLASSIFIED' ELSE 'UNCLASSIFIED' END AS status
FROM m""",
    "file",
)
def glob_classify(spark, sf_dir):
    return C.classify(relation(spark, sf_dir, "file"), SCOPES).drop("path", "host")


@query(
    """SELECT src, dst, CASE WHEN n < 1 THEN 'NO_PROVENANCE' WHEN open > 0 THEN 'UNRESOLVED' WHEN odd > 0 THEN 'METHOD' WHEN wrong > 0 THEN 'REFERENCE_KIND' ELSE 'PROVEN' END AS verdict
FROM (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n, count(*) FILTER (l_linestatus = 'F' AND l_linenumber = 7) AS open,
  count(*) FILTER (l_quantity = 50 AND l_tax > 0.07) AS odd, count(*) FILTER (l_discount >= 0.1 AND l_tax = 0) AS wrong
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""
)
def proven_dependencies(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    # proofs of an edge differ in few ways: kinds of proof are collected, not proofs
    proof = F.struct(
        F.lit("f").alias("file_path"),
        F.when((F.col("l_discount") >= 0.1) & (F.col("l_tax") == 0), "IMPORT").otherwise("CALL").alias("reference_kind"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 7), "UNRESOLVED").otherwise("RESOLVED").alias("resolution_status"),
        F.when((F.col("l_quantity") == 50) & (F.col("l_tax") > 0.07), "GUESS").otherwise("SAME_FILE").alias("resolution_method"),
    )
    edges = rows.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.collect_set(proof).alias("proofs"))
    problem = C.proof_problem(F.lit("CALLS"), F.col("proofs"), F.size("proofs"), F.lit(0))
    return edges.select("src", "dst", F.coalesce(problem, F.lit("PROVEN")).alias("verdict"))


# -- graphs -----------------------------------------------------------------------------------------------------

_REASON = """, r AS (SELECT a.layer AS src, b.layer AS dst, relation, occurrences, CASE WHEN relation NOT IN ('CALLS', 'IMPORTS') THEN 'filtered'
  WHEN a.layer = b.layer THEN 'self' WHEN occurrences <= 5 THEN 'unproven' END AS reason FROM dep LEFT JOIN component a ON src = a.v LEFT JOIN component b ON dst = b.v)
"""


def _projected(spark, sf_dir):
    owners = relation(spark, sf_dir, "component").select(F.col("v").alias("node"), F.col("layer").alias("owner"))
    return G.projected(relation(spark, sf_dir, "dep"), owners, ("CALLS", "IMPORTS"), F.col("occurrences") > 5)


@query(_REASON + "SELECT src, dst, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations, sum(occurrences)::BIGINT AS occurrences FROM r WHERE reason IS NULL GROUP BY ALL", "dep", "component")
def project_edges(spark, sf_dir):
    return G.projection_edges(_projected(spark, sf_dir))


@query(_REASON + "SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS edges FROM r GROUP BY ALL", "dep", "component")
def projection_reasons(spark, sf_dir):
    return G.reason_counts(_projected(spark, sf_dir))


_METRICS = """, m AS (SELECT v, (SELECT count(*) FROM arc WHERE dst = v)::BIGINT AS in_degree, (SELECT count(*) FROM arc WHERE src = v)::BIGINT AS out_degree,
  (SELECT count(*) FROM arc WHERE dst = v AND src <> v)::BIGINT AS ca, (SELECT count(*) FROM arc WHERE src = v AND dst <> v)::BIGINT AS ce,
  (SELECT count(*) FROM (SELECT dst AS w FROM arc WHERE src = v UNION SELECT src FROM arc WHERE dst = v) WHERE w <> v)::BIGINT AS total_neighbors FROM component),
i AS (SELECT *, CASE WHEN ca + ce > 0 THEN ce::DOUBLE / (ca + ce)::DOUBLE END AS instability FROM m)
"""


def _metrics(spark, sf_dir, edges="arc"):
    return G.node_metrics(relation(spark, sf_dir, "component").select("v"), relation(spark, sf_dir, edges))


_ALL_METRICS = _METRICS.replace(" arc ", " link ") + "SELECT *, in_degree / 24.0::DOUBLE AS in_centrality, out_degree / 24.0::DOUBLE AS out_centrality FROM i"


@query(_ALL_METRICS, "link", "component")
def node_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, "link")


@query(_ALL_METRICS, "link", "component")
def node_metrics_all_pairs(spark, sf_dir):
    return _metrics(spark, sf_dir, "link")


@part(
    _METRICS
    + """SELECT 'ARCH101' AS rule_id, v AS subject, NULL::VARCHAR AS object FROM i WHERE total_neighbors >= 6 UNION ALL SELECT 'ARCH102', v, NULL FROM i WHERE ca >= 5
UNION ALL SELECT 'ARCH104', a.src, a.dst FROM arc a JOIN i x ON a.src = x.v JOIN i y ON a.dst = y.v WHERE a.src <> a.dst AND y.instability - x.instability >= 0.2 - 1e-13""",
    "arc",
    "component",
)
def graph_candidates_part(spark, sf_dir):
    return G.candidates(_metrics(spark, sf_dir), relation(spark, sf_dir, "arc"), coupling=6, hub=5, members=3, methods=3, delta=0.2, central=0.1)


@query()
def graph_candidates(spark, sf_dir):
    return G.candidates(_metrics(spark, sf_dir, "link"), relation(spark, sf_dir, "link"), coupling=6, hub=5, members=3, methods=3, delta=0.2, central=0.1)


_REACH = """, e AS (SELECT src, dst FROM {0} WHERE src <> dst), reach(s, t) AS (SELECT src, dst FROM e UNION SELECT s, dst FROM reach JOIN e ON t = src),
c AS (SELECT v, least(v, coalesce((SELECT min(a.t) FROM reach a JOIN reach b ON a.s = b.t AND a.t = b.s WHERE a.s = v), v)) AS component FROM user_vertex)
"""


@part(_REACH.format("twofold") + "SELECT * FROM c", "twofold", "user_vertex", recursive=True)
def strong_components_part(spark, sf_dir):
    return G.scc(relation(spark, sf_dir, "user_vertex"), relation(spark, sf_dir, "twofold"))


@query()
def strong_components(spark, sf_dir):
    return G.scc(relation(spark, sf_dir, "user_vertex"), relation(spark, sf_dir, "follow"))


@part(
    _REACH.format("sparse")
    + """SELECT c.component, count(*)::BIGINT AS size, (SELECT count(*) FROM e JOIN c a ON src = a.v JOIN c b ON dst = b.v WHERE a.component = c.component AND b.component = c.component)::BIGINT AS internal_edges,
 count(*) > 1 AS is_cyclic FROM c GROUP BY c.component""",
    "sparse",
    "user_vertex",
    recursive=True,
)
def component_summary_part(spark, sf_dir):
    e = relation(spark, sf_dir, "sparse")
    return G.scc_summary(G.scc(relation(spark, sf_dir, "user_vertex"), e), e)


@query()
def component_summary(spark, sf_dir):
    e = relation(spark, sf_dir, "follow")
    return G.scc_summary(G.scc(relation(spark, sf_dir, "user_vertex"), e), e)


@query()
def cycle_proofs(spark, sf_dir):
    e = relation(spark, sf_dir, "follow")
    return G.cycle_proofs(G.scc(relation(spark, sf_dir, "user_vertex"), e), e)


@part(
    """, e AS (SELECT src, dst FROM twofold), w(v, d) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, d + 1 FROM w JOIN e ON v = src WHERE d < 4)
SELECT v, min(d)::INTEGER AS dist FROM w GROUP BY v""",
    "twofold",
    recursive=True,
)
def k_hop_part(spark, sf_dir):
    return G.neighbourhood(spark.createDataFrame([(1,)], "v long"), relation(spark, sf_dir, "twofold"), 4, max_nodes=100_000)


@query()
def k_hop(spark, sf_dir):
    return G.neighbourhood(spark.createDataFrame([(1,)], "v long"), relation(spark, sf_dir, "follow"), 4, max_nodes=100_000)


@part(
    """, w(s, v, d) AS (SELECT v, v, 0 FROM user_vertex WHERE v % 10 = 3 UNION SELECT s, dst, d + 1 FROM w JOIN twofold ON v = src WHERE d < 6)
SELECT s, v, min(d)::INTEGER AS dist FROM w GROUP BY s, v""",
    "twofold",
    "user_vertex",
    recursive=True,
)
def path_lengths_part(spark, sf_dir):
    s = relation(spark, sf_dir, "user_vertex").filter("v % 10 = 3").select(F.col("v").alias("s"))
    return G.distances(s, relation(spark, sf_dir, "twofold"), 6).drop("paths")


@query()
def path_lengths(spark, sf_dir):
    s = relation(spark, sf_dir, "user_vertex").select(F.col("v").alias("s"))
    return G.levels(s, relation(spark, sf_dir, "follow"), 6)


def _ranks(rounds: int) -> str:
    out = ", o AS (SELECT src, count(*) AS deg FROM twofold GROUP BY src), n AS (SELECT count(*)::DOUBLE AS n FROM user_vertex),\np0 AS MATERIALIZED (SELECT v, 1 / n AS r FROM user_vertex, n)"
    for k in range(1, rounds + 1):
        out += f""",
p{k} AS MATERIALIZED (SELECT v, 0.15 / n + 0.85 * (SELECT coalesce(sum(r), 0) FROM p{k - 1} WHERE v NOT IN (SELECT src FROM o)) / n
  + 0.85 * coalesce((SELECT sum(q.r / o.deg) FROM twofold t JOIN p{k - 1} q ON t.src = q.v JOIN o ON o.src = t.src WHERE t.dst = u.v), 0) AS r FROM user_vertex u, n)"""
    return out + f"\nSELECT v, round(r, 9) AS rank FROM p{rounds}"


@part(_ranks(6), "twofold", "user_vertex")
def pagerank_six_rounds_part(spark, sf_dir):
    ranks, _ = G.pagerank(relation(spark, sf_dir, "user_vertex"), relation(spark, sf_dir, "twofold"), rounds=6, fixed=True)
    return ranks.select("v", F.round("rank", 9).alias("rank"))


@query()
def pagerank_six_rounds(spark, sf_dir):
    ranks, _ = G.pagerank(relation(spark, sf_dir, "user_vertex"), relation(spark, sf_dir, "follow"), rounds=6, fixed=True)
    return ranks.select("v", F.round("rank", 9).alias("rank"))


@query()
def pagerank(spark, sf_dir):
    ranks, converged = G.pagerank(relation(spark, sf_dir, "user_vertex"), relation(spark, sf_dir, "follow"))
    if not converged:
        raise RuntimeError("ranks did not converge")
    return ranks


@part(
    """, w(s, v, d) AS (SELECT v, v, 0 FROM component UNION SELECT s, dst, d + 1 FROM w JOIN arc ON v = src WHERE d < 24),
d AS MATERIALIZED (SELECT s, v, min(d) AS d FROM w GROUP BY s, v),
k(s, v, d, n) AS (SELECT v, v, 0, 1::DOUBLE FROM component UNION ALL
  SELECT k.s, a.dst, k.d + 1, sum(k.n) FROM k JOIN arc a ON k.v = a.src JOIN d ON d.s = k.s AND d.v = a.dst AND d.d = k.d + 1 GROUP BY k.s, a.dst, k.d),
b AS (SELECT x.v, sum(x.n * y.n / z.n) AS b FROM k x JOIN k y ON x.v = y.s JOIN k z ON z.s = x.s AND z.v = y.v
  WHERE x.d + y.d = z.d AND x.v <> x.s AND x.v <> y.v GROUP BY x.v)
SELECT v, round(coalesce(b, 0) / (24 * 23)::DOUBLE, 9) AS betweenness FROM component LEFT JOIN b USING (v)""",
    "arc",
    "component",
    recursive=True,
)
def betweenness_part(spark, sf_dir):
    b = G.betweenness(relation(spark, sf_dir, "component").select("v"), relation(spark, sf_dir, "arc"))
    return b.select("v", F.round("betweenness", 9).alias("betweenness"))


@query()
def betweenness(spark, sf_dir):
    b = G.betweenness(relation(spark, sf_dir, "component").select("v"), relation(spark, sf_dir, "link"))
    return b.select("v", F.round("betweenness", 9).alias("betweenness"))


@query(
    """, p(child, parent) AS (SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
a(node, ancestor, depth) AS (SELECT child, parent, 1 FROM p UNION ALL SELECT node, p.parent, depth + 1 FROM a JOIN p ON a.ancestor = p.child)
SELECT node, ancestor, depth::INTEGER AS depth FROM a""".replace(", p(", "WITH RECURSIVE p(", 1)
)
def containment_ancestors(spark, sf_dir):
    link = lambda t, a, k, b, p: table(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(k)).alias("child"), F.concat(F.lit(b), F.col(p)).alias("parent"))
    world = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    return G.ancestors(link("supplier", "s", "s_suppkey", "n", "s_nationkey").union(link("nation", "n", "n_nationkey", "r", "n_regionkey")).union(world))


@query("""SELECT 's' || s_suppkey AS node, 'r' || n_regionkey AS owner FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region""")
def owner_climb(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.lit("METHOD").alias("kind"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.lit("FIELD"), F.concat(F.lit("r"), "n_regionkey"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("CLASS"), F.lit(None).cast("string"))
    return G.owners_of(s.union(n).union(r), ("CLASS", "INTERFACE"))


# -- discovery --------------------------------------------------------------------------------------------------


def _named(spark, sf_dir):
    """Names such as BuildingOrderService from market segments and part types."""
    role = F.element_at(F.array(*[F.lit(x) for x in ("Controller", "DomainService", "UseCase", "Dao", "HTTPClient", "Thing", "AggregateRoot")]), (F.col("c_custkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.initcap(F.col("c_mktsegment")), role).alias("name"))


@query("""SELECT c_custkey, ['CONTROLLER', 'DOMAIN_SERVICE', 'SERVICE', 'REPOSITORY', 'CLIENT', NULL, 'DOMAIN_MODEL'][c_custkey % 7 + 1] AS role FROM customer""")
def name_roles(spark, sf_dir):
    return _named(spark, sf_dir).select("c_custkey", D.name_role(F.col("name")).alias("role"))


_DIRS = "['controllers', 'service', 'dao', 'domain', 'misc', 'utils'][page_id % 6 + 1]"


@query(
    f""", d AS (SELECT page_id, {_DIRS} AS segment FROM file)
SELECT page_id, segment, CASE segment WHEN 'controllers' THEN 'CONTROLLER' WHEN 'service' THEN 'SERVICE' WHEN 'dao' THEN 'REPOSITORY' WHEN 'utils' THEN 'UTILITY' END AS role,
 CASE segment WHEN 'controllers' THEN 'PRESENTATION' WHEN 'service' THEN 'APPLICATION' WHEN 'dao' THEN 'PERSISTENCE' WHEN 'domain' THEN 'DOMAIN' END AS layer FROM d WHERE segment <> 'misc'""",
    "file",
)
def path_signals(spark, sf_dir):
    dirs = F.element_at(F.array(*[F.lit(x) for x in ("Controllers", "service", "dao", "domain", "misc", "utils")]), (F.col("page_id") % 6 + 1).cast("int"))
    rows = relation(spark, sf_dir, "file").select("page_id", F.concat(dirs, F.lit("/"), "path").alias("path"))
    return D.path_signals(rows).drop("path")


_EVIDENCE = """, ev AS (SELECT c_nationkey AS subject, CASE c_custkey % 3 WHEN 0 THEN 'SERVICE' WHEN 1 THEN 'REPOSITORY' ELSE 'CONTROLLER' END AS role,
   CASE c_custkey % 5 WHEN 0 THEN 2 ELSE 1 END AS strength, CASE c_custkey % 11 WHEN 0 THEN 'NAME' WHEN 1 THEN 'PATH' ELSE 'IMPORT' END AS kind FROM customer WHERE c_custkey % 4 = 1),
g AS (SELECT subject, role, CASE WHEN bool_or(kind = 'NAME') AND bool_or(kind = 'PATH') THEN 3 ELSE max(strength) END AS s FROM ev GROUP BY ALL),
t AS (SELECT subject, max(s) AS top FROM g GROUP BY subject),
k AS (SELECT subject, top, count(*) AS n, min(role) AS role FROM g JOIN t USING (subject) WHERE s = top GROUP BY ALL)
SELECT subject, CASE WHEN top < 2 OR n > 1 THEN 'UNKNOWN' ELSE role END AS role, top AS strength, CASE WHEN top < 2 THEN 'UNKNOWN' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status FROM k"""


def _evidence(customers):
    pick = lambda n, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("c_custkey") % n + 1).cast("int"))
    return customers.select(
        F.col("c_nationkey").alias("subject"),
        pick(3, "SERVICE", "REPOSITORY", "CONTROLLER").alias("role"),
        F.when(F.col("c_custkey") % 5 == 0, 2).otherwise(1).alias("strength"),
        F.when(F.col("c_custkey") % 11 == 0, "NAME").when(F.col("c_custkey") % 11 == 1, "PATH").otherwise("IMPORT").alias("kind"),
    )


@part(_EVIDENCE.replace(", ev", "WITH ev", 1))
def role_arbitration_part(spark, sf_dir):
    return D.arbitrate(_evidence(table(spark, sf_dir, "customer").filter("c_custkey % 4 = 1")))


@query()
def role_arbitration(spark, sf_dir):
    return D.arbitrate(_evidence(table(spark, sf_dir, "customer")))


@query(
    """WITH r AS (SELECT c_nationkey AS subject, CASE c_custkey % 40 WHEN 0 THEN 'APPLICATION' WHEN 1 THEN 'PERSISTENCE' END AS layer FROM customer)
SELECT subject, CASE WHEN count(DISTINCT layer) = 1 THEN min(layer) ELSE 'UNKNOWN' END AS layer, coalesce(string_agg(DISTINCT layer, ',' ORDER BY layer), '') AS candidates,
 CASE count(DISTINCT layer) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status FROM r GROUP BY subject"""
)
def layer_inference(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    roles = c.select(F.col("c_nationkey").alias("subject"), F.when(F.col("c_custkey") % 40 == 0, "SERVICE").alias("role"))
    hints = c.select(F.col("c_nationkey").alias("subject"), F.when(F.col("c_custkey") % 40 == 1, "PERSISTENCE").alias("layer"))
    return D.layers(roles, hints)


@query(
    """, s AS (SELECT host, page_id, str_split(path, '/') AS p FROM file), l AS (SELECT host, min(len(p)) AS m, list(p) AS ps FROM s GROUP BY host),
x AS (SELECT host, len(list_filter(range(1, m + 1), lambda k: len(list_distinct(list_transform(ps, lambda q: array_to_string(q[1:k], '/')))) = 1)) AS depth, ps[1] AS one FROM l)
SELECT host, array_to_string(one[1:depth], '/') AS prefix, depth::INTEGER AS depth FROM x""",
    "file",
)
def common_prefixes(spark, sf_dir):
    return D.common_prefix(relation(spark, sf_dir, "file"), "host", "path")


@query("SELECT split_part(path, '/', 1) AS module, count(*)::BIGINT AS members FROM file WHERE len(str_split(path, '/')) > 1 GROUP BY ALL HAVING count(*) >= 2", "file")
def module_seeds(spark, sf_dir):
    return D.module_seeds(relation(spark, sf_dir, "file"))


def _labels(spark, sf_dir):
    return relation(spark, sf_dir, "component").select("v", F.col("layer").alias("label"))


@part("SELECT a.layer AS src_label, b.layer AS dst_label, count(*)::BIGINT AS edges FROM arc JOIN component a ON src = a.v JOIN component b ON dst = b.v GROUP BY ALL", "arc", "component")
def dependency_matrix_part(spark, sf_dir):
    return D.matrix(relation(spark, sf_dir, "arc"), _labels(spark, sf_dir))


@query()
def dependency_matrix(spark, sf_dir):
    return D.matrix(relation(spark, sf_dir, "link"), _labels(spark, sf_dir))


@part(
    """, x AS (SELECT a.layer AS s, b.layer AS d FROM arc JOIN component a ON src = a.v JOIN component b ON dst = b.v),
y AS (SELECT layer AS label, count(*)::BIGINT AS members, (SELECT count(*) FROM x WHERE s = layer AND d = layer)::BIGINT AS internal,
 (SELECT count(*) FROM x WHERE s = layer AND d <> layer)::BIGINT AS outgoing, (SELECT count(*) FROM x WHERE s <> layer AND d = layer)::BIGINT AS incoming FROM component GROUP BY layer)
SELECT *, internal / nullif(internal + outgoing + incoming, 0)::DOUBLE AS ratio, CASE WHEN members >= 2 AND internal > outgoing + incoming THEN 'STRONG' ELSE 'MODERATE' END AS strength FROM y""",
    "arc",
    "component",
)
def module_cohesion_part(spark, sf_dir):
    return D.cohesion(relation(spark, sf_dir, "arc"), _labels(spark, sf_dir))


@query()
def module_cohesion(spark, sf_dir):
    return D.cohesion(relation(spark, sf_dir, "link"), _labels(spark, sf_dir))


@part(_METRICS + "SELECT v, ca, row_number() OVER (ORDER BY ca DESC, v)::INTEGER AS rank FROM i ORDER BY ca DESC, v LIMIT 5", "arc", "component")
def topology_top_k_part(spark, sf_dir):
    return D.top_k(_metrics(spark, sf_dir).select("v", "ca"), "ca", "v", 5)


@query()
def topology_top_k(spark, sf_dir):
    return D.top_k(_metrics(spark, sf_dir, "link").select("v", "ca"), "ca", "v", 5)


@part(
    """, x AS (SELECT a.layer AS s, b.layer AS d FROM arc JOIN component a ON src = a.v JOIN component b ON dst = b.v), n AS (SELECT r_name AS label FROM region UNION ALL SELECT 'NOWHERE')
SELECT label, (SELECT count(*) FROM component WHERE layer = label)::BIGINT AS members, (SELECT count(*) FROM component WHERE layer = label AND nationkey % 3 = 0)::BIGINT AS weak, (SELECT count(*) FROM component WHERE layer = label AND nationkey % 3 = 1)::BIGINT AS moderate,
 (SELECT count(*) FROM component WHERE layer = label AND nationkey % 3 = 2)::BIGINT AS strong, (SELECT count(*) FROM x WHERE s = label AND d = label)::BIGINT AS internal, (SELECT count(*) FROM x WHERE s = label AND d <> label)::BIGINT AS outgoing,
 (SELECT count(*) FROM x WHERE s <> label AND d = label)::BIGINT AS incoming FROM n""",
    "arc",
    "component",
)
def layer_groups_part(spark, sf_dir):
    subjects = relation(spark, sf_dir, "component").select("v", F.col("layer").alias("label"), (F.col("nationkey") % 3 + 1).alias("strength"))
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("label")).union(spark.createDataFrame([("NOWHERE",)], "label string"))
    return D.layer_groups(subjects, relation(spark, sf_dir, "arc"), names)


@query()
def layer_groups(spark, sf_dir):
    subjects = relation(spark, sf_dir, "component").select("v", F.col("layer").alias("label"), (F.col("nationkey") % 3 + 1).alias("strength"))
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("label")).union(spark.createDataFrame([("NOWHERE",)], "label string"))
    return D.layer_groups(subjects, relation(spark, sf_dir, "link"), names)


@query("SELECT 'n' || s_nationkey AS owner, count(*)::BIGINT AS member_count, count(*) FILTER (s_suppkey % 2 = 0)::BIGINT AS method_count FROM supplier GROUP BY s_nationkey")
def node_rollup(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("owner"), F.concat(F.lit("s"), k).alias("node"), F.when(k % 2 == 0, "METHOD").otherwise("FIELD").alias("kind"))
    own = rows.select("owner", F.col("owner").alias("node"), F.lit("CLASS").alias("kind")).distinct()
    return G.node_rollup(rows.union(own))


@part("SELECT a.v AS subject, string_agg(DISTINCT b.layer, ',' ORDER BY b.layer) AS evidence FROM arc JOIN component a ON src = a.v JOIN component b ON dst = b.v WHERE a.layer < b.layer GROUP BY a.v", "arc", "component")
def direction_evidence_part(spark, sf_dir):
    order = {n: i for i, n in enumerate(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))}
    return D.direction_evidence(relation(spark, sf_dir, "arc"), _labels(spark, sf_dir), order)


@query()
def direction_evidence(spark, sf_dir):
    order = {n: i for i, n in enumerate(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))}
    return D.direction_evidence(relation(spark, sf_dir, "link"), _labels(spark, sf_dir), order)


@query()
def circular_findings(spark, sf_dir):
    from .repository import cycle_findings

    return cycle_findings(relation(spark, sf_dir, "follow"), "ARCH003")
