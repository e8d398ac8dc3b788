"""Queries of intake, resolution, security and hybrid fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import fusion as H
from plumbline.operators import resolution as R
from plumbline.operators import security as S
from plumbline.sources import intake as I

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


_NAMES = "['src/main/java/A', 'lib/generated/B', 'test/C', 'docs/D', 'src/app/E.spec', 'F'][page_id % 6 + 1] || page_id || ['.java', '.ts', '.md', '.png', '.json', '.js', ''][page_id % 7 + 1]"


def _files(spark, sf_dir):
    pick = lambda n, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("page_id") % n + 1).cast("int"))
    stem = pick(6, "src/main/java/A", "lib/generated/B", "test/C", "docs/D", "src/app/E.spec", "F")
    path = F.concat(stem, F.col("page_id"), pick(7, ".java", ".ts", ".md", ".png", ".json", ".js", ""))
    return I.classified(table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.octet_length("html").cast("long").alias("size_bytes")))


_CLASSIFIED = f"""WITH p AS (SELECT page_id, {_NAMES} AS path, octet_length(encode(html)) AS size_bytes, page_id % 6 AS a, page_id % 7 AS b FROM pages),
c AS (SELECT *, ['JAVA', 'TYPESCRIPT', 'MARKDOWN', NULL, 'JSON', 'JAVASCRIPT', NULL][b + 1] AS language,
 CASE WHEN b = 3 THEN 'BINARY' WHEN a = 1 THEN 'GENERATED' WHEN b IN (0, 1, 5) THEN CASE WHEN a = 2 THEN 'TEST' ELSE 'SOURCE' END WHEN b = 4 THEN 'CONFIG' WHEN b = 2 THEN 'DOCUMENTATION' ELSE 'OTHER' END AS kind FROM p),
f AS (SELECT *, kind IN ('SOURCE', 'TEST') AS ok FROM c)
"""


@query(_CLASSIFIED + "SELECT page_id, path, language, kind, ok AS analysis_eligible FROM f")
def file_classification(spark, sf_dir):
    return _files(spark, sf_dir).select("page_id", "path", "language", "kind", "analysis_eligible")


@query(
    _CLASSIFIED
    + """SELECT CASE a WHEN 0 THEN 'src/main/java' WHEN 2 THEN 'test' WHEN 4 THEN 'src' ELSE '' END AS root, kind = 'TEST' AS is_test, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, count(*)::BIGINT AS files FROM f WHERE ok GROUP BY 1, 2"""
)
def source_roots(spark, sf_dir):
    return I.source_roots(_files(spark, sf_dir))


@query(
    _CLASSIFIED
    + """SELECT CASE WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(language) = 0 THEN 'language' ELSE 'total' END AS dimension,
 CASE WHEN grouping(kind) = 1 AND grouping(language) = 1 THEN '*' ELSE coalesce(kind, language, 'none') END AS value, count(*)::BIGINT AS files FROM f GROUP BY GROUPING SETS ((kind), (language), ())"""
)
def inventory_statistics(spark, sf_dir):
    return I.statistics(_files(spark, sf_dir))


@query(
    _CLASSIFIED.replace("WITH p AS", "WITH RECURSIVE p AS", 1)
    + """, s AS (SELECT page_id // 20 AS snapshot, path, kind, size_bytes, row_number() OVER (PARTITION BY page_id // 20 ORDER BY path) AS r FROM f),
t AS (SELECT snapshot, path, r, CASE WHEN kind = 'BINARY' THEN 'BINARY' WHEN size_bytes > 3000 THEN 'TOO_LARGE' WHEN size_bytes <= 12000 THEN 'HASHED' ELSE 'BUDGET' END AS hash_status,
  12000 - CASE WHEN kind <> 'BINARY' AND size_bytes <= 3000 THEN size_bytes ELSE 0 END AS room FROM s WHERE r = 1
 UNION ALL SELECT s.snapshot, s.path, s.r, CASE WHEN s.kind = 'BINARY' THEN 'BINARY' WHEN s.size_bytes > 3000 THEN 'TOO_LARGE' WHEN s.size_bytes <= t.room THEN 'HASHED' ELSE 'BUDGET' END,
  t.room - CASE WHEN s.kind <> 'BINARY' AND s.size_bytes <= 3000 AND s.size_bytes <= t.room THEN s.size_bytes ELSE 0 END FROM t JOIN s ON s.snapshot = t.snapshot AND s.r = t.r + 1)
SELECT snapshot, path, hash_status FROM t"""
)
def hash_budget(spark, sf_dir):
    return I.hash_budget(_files(spark, sf_dir).withColumn("snapshot", F.floor(F.col("page_id") / 20)), "snapshot", limit=3_000, budget=12_000)


# -- resolution -------------------------------------------------------------------------------------------------


@part(
    """, h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)', 1)) AS word FROM pages), r AS (SELECT DISTINCT word FROM h),
d AS (SELECT DISTINCT lower(word) AS word, page_id FROM h WHERE page_id % 9 = 0),
n AS (SELECT r.word, count(d.page_id)::BIGINT AS candidates, min(d.page_id) AS one FROM r LEFT JOIN d ON lower(r.word) = d.word GROUP BY r.word)
SELECT word, candidates, CASE candidates WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN candidates = 1 THEN one END AS target FROM n""".replace(", h AS", "WITH h AS", 1)
)
def resolve_status_part(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)'), F.lit(1))).alias("word"))
    refs = h.select("word").distinct()
    found = h.filter("page_id % 9 = 0").select(F.lower("word").alias("w"), F.col("page_id").alias("t"))
    found = refs.join(found, F.lower("word") == F.col("w")).select("word", "t")
    return R.choose(refs, found, "word", "t")


@query()
def resolve_status(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)'), F.lit(1))).alias("word"))
    refs = h.select("word").distinct()
    found = h.select(F.lower("word").alias("w"), F.col("page_id").alias("t"))
    found = refs.join(found, F.lower("word") == F.col("w")).select("word", "t")
    return R.choose(refs, found, "word", "t")


@part(
    """WITH r AS (SELECT o_orderkey AS ref, o_custkey AS k FROM orders WHERE o_orderkey % 20 = 1),
s AS (SELECT ref, 0 AS i, c_custkey AS t FROM r JOIN customer ON k = c_custkey AND c_custkey % 3 = 0 UNION ALL SELECT ref, 1, c_custkey FROM r JOIN customer ON k // 2 = c_custkey // 2 AND c_custkey % 5 < 3
  UNION ALL SELECT ref, 2, c_custkey FROM r JOIN customer ON k // 4 = c_custkey // 4),
g AS (SELECT ref, i, count(DISTINCT t) AS n, min(t) AS t FROM s GROUP BY ALL), f AS (SELECT ref, min(i) AS i FROM g GROUP BY ref)
SELECT r.ref, ['CONTAINER', 'IMPORT', 'GLOBAL'][f.i + 1] AS method, CASE WHEN n > 1 THEN 'AMBIGUOUS' WHEN n = 1 AND f.i < 2 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status, CASE WHEN n = 1 AND f.i < 2 THEN t END AS target
FROM r LEFT JOIN f ON r.ref = f.ref LEFT JOIN g ON g.ref = f.ref AND g.i = f.i"""
)
def resolution_ladder_part(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").filter("o_orderkey % 20 = 1").select(F.col("o_orderkey").alias("ref"), F.col("o_custkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("t"))
    near = lambda n: F.floor(F.col("k") / n) == F.floor(F.col("t") / n)
    stages = [("CONTAINER", refs.join(c.filter("t % 3 = 0"), F.col("k") == F.col("t")), True), ("IMPORT", refs.join(c.filter("t % 5 < 3"), near(2)), True), ("GLOBAL", refs.join(c, near(4)), False)]
    return R.ladder(refs, [(m, d.select("ref", "t"), may) for m, d, may in stages], "ref", "t").drop("k")


@query()
def resolution_ladder(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"), F.col("o_custkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("t"))
    near = lambda n: F.floor(F.col("k") / n) == F.floor(F.col("t") / n)
    stages = [("CONTAINER", refs.join(c.filter("t % 3 = 0"), F.col("k") == F.col("t")), True), ("IMPORT", refs.join(c.filter("t % 5 < 3"), near(2)), True), ("GLOBAL", refs.join(c, near(4)), False)]
    return R.ladder(refs, [(m, d.select("ref", "t"), may) for m, d, may in stages], "ref", "t").drop("k")


@part(
    """SELECT o_orderkey, count(*) FILTER (l_linenumber IS NOT NULL)::BIGINT AS overloads FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
 AND (o_custkey % 10 = 0 OR (o_custkey % 7 >= l_linenumber - 1 AND (l_returnflag = 'R' OR o_custkey % 7 <= l_linenumber + 1))) WHERE o_orderkey % 10 = 3 GROUP BY o_orderkey"""
)
def arity_join_part(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 3")
    n = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey") % 7)
    fits = R.arity_fits(n, F.col("l_linenumber") - 1, F.col("l_linenumber") + 1, F.col("l_returnflag") == "R")
    rows = o.join(table(spark, sf_dir, "lineitem"), (F.col("o_orderkey") == F.col("l_orderkey")) & fits, "left")
    return rows.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("overloads"))


@query()
def arity_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey") % 7)
    fits = R.arity_fits(n, F.col("l_linenumber") - 1, F.col("l_linenumber") + 1, F.col("l_returnflag") == "R")
    rows = o.join(table(spark, sf_dir, "lineitem"), (F.col("o_orderkey") == F.col("l_orderkey")) & fits, "left")
    return rows.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("overloads"))


@query(
    """WITH r AS (SELECT l_suppkey AS source, l_returnflag AS target, l_linestatus AS kind, count(*) AS n, count(*) FILTER (k <= 3) AS kept, string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber) FILTER (k <= 3) AS proofs
 FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) GROUP BY ALL)
SELECT source, target, kind, n::BIGINT AS occurrences, (n - kept)::BIGINT AS provenance_truncated, proofs FROM r"""
)
def provenance_top_k(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("target"), F.col("l_linestatus").alias("kind"), F.lit("f").alias("file_path"), F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("col"), F.lit("").alias("key")
    )
    out = R.edges_with_provenance(refs, 3)
    return out.withColumn("proofs", F.array_join(F.transform("proofs", lambda p: F.concat_ws(":", p["line"], p["col"])), ","))


@part(
    """WITH n AS (SELECT n_nationkey AS k, n_regionkey AS p FROM nation), e AS (SELECT o_orderkey AS edge, o_custkey % 27 AS src, o_custkey % 26 AS dst, o_orderkey % 4 AS occ, least(o_orderkey % 4, 2) AS pr FROM orders WHERE o_orderkey % 50 = 7)
SELECT 'edge src' AS "check", edge::VARCHAR AS id FROM e WHERE src NOT IN (SELECT k FROM n) UNION ALL SELECT 'edge dst', edge::VARCHAR FROM e WHERE dst NOT IN (SELECT k FROM n)
UNION ALL SELECT 'proof count', edge::VARCHAR FROM e WHERE occ <> pr UNION ALL SELECT 'one root', count(*)::VARCHAR FROM n WHERE k < 5 HAVING count(*) <> 1"""
)
def model_violations_part(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.when(F.col("n_nationkey") >= 5, F.col("n_regionkey")).alias("parent"))
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").filter("o_orderkey % 50 = 7").select(
        o.alias("edge"), (c % 27).cast("int").alias("src"), (c % 26).cast("int").alias("dst"), (o % 4).alias("occurrences"), F.least(o % 4, F.lit(2)).alias("proofs"), F.lit(0).alias("truncated")
    )
    return R.model_violations(n, e)


@query()
def model_violations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.when(F.col("n_nationkey") >= 5, F.col("n_regionkey")).alias("parent"))
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(
        o.alias("edge"), (c % 27).cast("int").alias("src"), (c % 26).cast("int").alias("dst"), (o % 4).alias("occurrences"), F.least(o % 4, F.lit(2)).alias("proofs"), F.lit(0).alias("truncated")
    )
    return R.model_violations(n, e)


# -- security ---------------------------------------------------------------------------------------------------

_PAIRS = r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\w+ ?[=:] ?"?[A-Za-z0-9_+/\-]{16,}')) AS hit FROM documents),
p AS (SELECT doc_id, regexp_extract(hit, '^(\w+)', 1) AS name, regexp_extract(hit, '[=:] ?"?([A-Za-z0-9_+/\-]+)$', 1) AS value FROM m)
"""


def _pairs(spark, sf_dir):
    hits = F.regexp_extract_all("text", F.lit(r'([A-Za-z0-9_]+ ?[=:] ?"?[A-Za-z0-9_+/\-]{16,})'), F.lit(1))
    m = table(spark, sf_dir, "documents").select("doc_id", F.explode(hits).alias("hit"))
    return m.select("doc_id", F.regexp_extract("hit", "^([A-Za-z0-9_]+)", 1).alias("name"), F.regexp_extract("hit", r'[=:] ?"?([A-Za-z0-9_+/\-]+)$', 1).alias("value"))


_TELLING = r"""len(list_intersect(regexp_split_to_array(lower(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g')), '[^a-z]+'), ['password', 'secret', 'session', 'nonce', 'csrf', 'auth', 'reset', 'token', 'key'])) > 0"""


@query(
    _PAIRS
    + rf""", j AS (SELECT *, CASE WHEN regexp_matches(value, '(?i)placeholder|example|changeme|your[_ -]') OR regexp_matches(name, '(?i)checksum|cache|fingerprint|simulation|shuffle|sample|parser|label|game') THEN false
  ELSE regexp_matches(value, '^(sk-[A-Za-z0-9_-]{{20,}}|ghp_[A-Za-z0-9]{{30,}}|AKIA[A-Z0-9]{{16}})$') OR ({_TELLING} AND length(value) >= 28 AND len(list_distinct(str_split(value, ''))) >= 12
   AND regexp_matches(value, '[a-z]')::INT + regexp_matches(value, '[A-Z]')::INT + regexp_matches(value, '[0-9]')::INT + regexp_matches(value, '[^A-Za-z0-9_]')::INT >= 3 AND NOT regexp_matches(value, '^[0-9a-fA-F-]+$')) END AS secret FROM p)
SELECT doc_id, name, value, secret FROM j"""
)
def secret_verdicts(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("secret", S.is_secret(F.col("name"), F.col("value")))


@query(
    _PAIRS
    + rf"""SELECT doc_id, count(*)::BIGINT AS pairs, count(*) FILTER (length(value) >= 28)::BIGINT AS long, count(*) FILTER (regexp_matches(value, '^[0-9a-fA-F-]+$'))::BIGINT AS hex,
 count(*) FILTER (len(list_distinct(str_split(value, ''))) >= 12)::BIGINT AS varied, count(*) FILTER ({_TELLING})::BIGINT AS telling FROM p GROUP BY doc_id"""
)
def secret_scan(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    parts = S.secret_parts(F.col("name"), F.col("value"))
    count = lambda c: F.count_if(parts[c])
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), count("long").alias("long"), count("hex").alias("hex"), count("varied").alias("varied"), count("telling_name").alias("telling"))


@query(
    """WITH c AS (SELECT event_id, ['pg.Pool.query', 'fs.readFile', 'eval', 'console.log', 'https.get'][event_id % 5 + 1] AS api, CASE WHEN user_id % 2 = 0 THEN 'TYPESCRIPT' ELSE 'JAVA' END AS language FROM events)
SELECT CASE api WHEN 'pg.Pool.query' THEN 'SEC002' WHEN 'fs.readFile' THEN 'SEC004' WHEN 'eval' THEN 'SEC010' ELSE 'SEC006' END AS rule_id, count(*)::BIGINT AS calls FROM c WHERE language = 'TYPESCRIPT' AND api <> 'console.log' GROUP BY 1"""
)
def sink_lookup(spark, sf_dir):
    api = F.element_at(F.array(*[F.lit(x) for x in ("pg.Pool.query", "fs.readFile", "eval", "console.log", "https.get")]), (F.col("event_id") % 5 + 1).cast("int"))
    calls = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, "TYPESCRIPT").otherwise("JAVA").alias("language"), api.alias("api"))
    return S.sinks(calls).groupBy("rule_id").agg(F.count(F.lit(1)).alias("calls"))


@query(
    """WITH v AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 31 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 7 = 0 THEN 'TAINTED' WHEN o_orderkey % 3 = 0 THEN 'SANITIZED' ELSE 'UNTAINTED' END AS s,
  o_orderkey % 2 = 0 AS a, o_orderkey % 5 > 0 AS b, 1 + o_orderkey % 4 AS p FROM orders),
g AS (SELECT k, bool_or(s = 'UNKNOWN') OR sum(p) > 32 AS u, bool_or(s = 'TAINTED') AS t, count(*) FILTER (s = 'SANITIZED') AS n, coalesce(bool_and(a) FILTER (s = 'SANITIZED'), false) AS a, coalesce(bool_and(b) FILTER (s = 'SANITIZED'), false) AS b FROM v GROUP BY k),
r AS (SELECT *, CASE WHEN u THEN 'UNKNOWN' WHEN t THEN 'TAINTED' WHEN n > 0 AND (a OR b) THEN 'SANITIZED' WHEN n > 0 THEN 'TAINTED' ELSE 'UNTAINTED' END AS state FROM g)
SELECT k, state, CASE WHEN state = 'SANITIZED' THEN concat_ws(',', CASE WHEN a THEN 'SEC002' END, CASE WHEN b THEN 'SEC007' END) ELSE '' END AS sanitized_for FROM r"""
)
def flow_lattice(spark, sf_dir):
    k = F.col("o_orderkey")
    state = F.when(k % 31 == 0, "UNKNOWN").when(k % 7 == 0, "TAINTED").when(k % 3 == 0, "SANITIZED").otherwise("UNTAINTED")
    rules = F.array_compact(F.array(F.when(k % 2 == 0, "SEC002"), F.when(k % 5 > 0, "SEC007")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), state.alias("state"), rules.alias("sanitized"), (1 + k % 4).alias("paths"))
    return S.merge_flows(rows, ["k"])


@query(
    """SELECT c_custkey, c_mktsegment IN ('MD5', 'X') OR c_custkey % 3 = 0 AS weak, CASE WHEN c_custkey % 4 < 2 AND c_custkey % 2 = 0 THEN 'CONFIRMED' WHEN c_custkey % 4 = 1 THEN 'CONFIRMED' WHEN c_custkey % 4 = 3 THEN NULL ELSE NULL END AS state FROM customer"""
)
def weak_crypto_states(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.lit("SHA-1")).otherwise("SHA-256")
    tags = F.when(k % 4 < 2, F.array(F.lit("SECURITY"))).otherwise(F.array(F.lit("NONSECURITY")))
    rule = F.when(k % 2 == 0, "SEC008").otherwise("SEC009")
    return table(spark, sf_dir, "customer").select("c_custkey", S.weak_algorithm(name).alias("weak"), S.randomness_state(tags, F.lit(False), rule).alias("state"))


# -- hybrid -----------------------------------------------------------------------------------------------------


@query("""SELECT user_id AS node, event_type AS rule, min(event_id % 10) AS priority, min_by(event_id % 3, (event_id % 10) * 10 + event_id % 3) AS reason FROM events GROUP BY ALL ORDER BY priority, node, rule LIMIT 40""")
def context_targets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("event_type").alias("rule"), (F.col("event_id") % 10).alias("priority"), (F.col("event_id") % 3).alias("reason"))
    return H.targets(e, 40)


@part("""WITH b AS (SELECT src AS node, min(dst % 4) AS priority FROM twofold GROUP BY src) SELECT node, priority, (SELECT min(t.dst % 9) FROM twofold t WHERE t.src = b.node AND t.dst % 4 = b.priority) AS distance FROM b ORDER BY priority, distance, node LIMIT 20""".replace("WITH b AS", ", b AS", 1), "twofold")
def context_selection_part(spark, sf_dir):
    rows = relation(spark, sf_dir, "twofold").select(F.col("src").alias("node"), (F.col("dst") % 4).alias("priority"), (F.col("dst") % 9).alias("distance"))
    return H.context_nodes(rows, 20)


@query()
def context_selection(spark, sf_dir):
    rows = relation(spark, sf_dir, "follow").select(F.col("src").alias("node"), (F.col("dst") % 4).alias("priority"), (F.col("dst") % 9).alias("distance"))
    return H.context_nodes(rows, 20)


@query()
def fragment_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("file"), F.col("l_linenumber").cast("long").alias("priority"), (F.col("l_orderkey") % 500).alias("start"), (F.col("l_orderkey") % 500 + F.col("l_quantity")).cast("long").alias("end")
    )
    return H.fragments(rows)


@part(
    """WITH c AS (SELECT c_custkey AS case_id, 's' || c_nationkey AS subject, CASE WHEN c_custkey % 2 = 0 THEN 's' || (c_nationkey + 1) % 25 END AS object FROM customer WHERE c_custkey % 15 = 0),
e AS (SELECT s_suppkey AS evidence_id, CASE WHEN s_suppkey % 3 = 0 THEN 'r' || n_regionkey ELSE 's' || s_nationkey END AS subject, CASE WHEN s_suppkey % 3 = 1 THEN 's' || (s_nationkey + 1) % 25 END AS object FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT 's' || n_nationkey AS child, 'r' || n_regionkey AS ancestor FROM nation), g AS (SELECT 's' || n_nationkey AS a, 's' || (n_nationkey + 5) % 25 AS b FROM nation),
m AS (SELECT case_id, evidence_id, CASE WHEN c.subject = e.subject AND c.object = e.object THEN 1 WHEN (c.object IS NULL OR e.object IS NULL) AND c.subject = e.subject THEN 2
  WHEN (c.object IS NULL OR e.object IS NULL) AND EXISTS (SELECT 1 FROM u WHERE (child = c.subject AND ancestor = e.subject) OR (child = e.subject AND ancestor = c.subject)) THEN 3
  WHEN c.object IS NULL AND EXISTS (SELECT 1 FROM g WHERE (a = c.subject AND b = e.subject) OR (b = c.subject AND a = e.subject)) THEN 4 END AS k FROM c CROSS JOIN e)
SELECT case_id, evidence_id, ['EXACT_SUBJECT_PAIR', 'EXACT_SUBJECT', 'CONTAINMENT_OWNER', 'DIRECT_GRAPH_RELATION'][k] AS method FROM m WHERE k IS NOT NULL"""
)
def evidence_alignment_part(spark, sf_dir):
    s = lambda c: F.concat(F.lit("s"), c)
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    cases = table(spark, sf_dir, "customer").filter("c_custkey % 15 = 0").select(k.alias("case_id"), s(n).alias("subject"), F.when(k % 2 == 0, s((n + 1) % 25)).alias("object"))
    nation = table(spark, sf_dir, "nation")
    p, m = F.col("s_suppkey"), F.col("s_nationkey")
    e = table(spark, sf_dir, "supplier").join(nation, m == F.col("n_nationkey"))
    e = e.select(p.alias("evidence_id"), F.when(p % 3 == 0, F.concat(F.lit("r"), "n_regionkey")).otherwise(s(m)).alias("subject"), F.when(p % 3 == 1, s((m + 1) % 25)).alias("object"))
    up = nation.select(s(F.col("n_nationkey")).alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("ancestor"))
    g = nation.select(s(F.col("n_nationkey")).alias("src"), s((F.col("n_nationkey") + 5) % 25).alias("dst"))
    return H.align(cases, e, up, g)


@query()
def evidence_alignment(spark, sf_dir):
    s = lambda c: F.concat(F.lit("s"), c)
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    cases = table(spark, sf_dir, "customer").select(k.alias("case_id"), s(n).alias("subject"), F.when(k % 2 == 0, s((n + 1) % 25)).alias("object"))
    nation = table(spark, sf_dir, "nation")
    p, m = F.col("s_suppkey"), F.col("s_nationkey")
    e = table(spark, sf_dir, "supplier").join(nation, m == F.col("n_nationkey"))
    e = e.select(p.alias("evidence_id"), F.when(p % 3 == 0, F.concat(F.lit("r"), "n_regionkey")).otherwise(s(m)).alias("subject"), F.when(p % 3 == 1, s((m + 1) % 25)).alias("object"))
    up = nation.select(s(F.col("n_nationkey")).alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("ancestor"))
    g = nation.select(s(F.col("n_nationkey")).alias("src"), s((F.col("n_nationkey") + 5) % 25).alias("dst"))
    return H.align(cases, e, up, g)


@query(
    """SELECT doc_id, CASE WHEN quality IS NULL THEN 'MISSING' WHEN doc_id % 3 <> 0 OR doc_id % 2 = 0 THEN 'NEUTRAL' WHEN quality = 1 THEN 'SUPPORTING' ELSE 'CONTRADICTING' END AS agreement,
 CASE WHEN doc_id % 10 = 0 THEN 'CONFIRMED' WHEN toxic = 1 OR quality IS NOT NULL THEN 'REVIEW' ELSE 'INSUFFICIENT' END AS decision, concat_ws(',', CASE WHEN coalesce(toxic = 1, false) THEN 'graph' END, CASE WHEN doc_id % 10 = 0 THEN 'proof' END) AS reasons
FROM documents LEFT JOIN labels USING (doc_id)"""
)
def hybrid_decisions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    d, decided = F.col("doc_id"), F.when(F.col("quality") == 1, "SUPPORTED").when(F.col("quality") == 0, "NOT_SUPPORTED")
    semantic = F.when(d % 3 == 0, "ARCH205").otherwise("ARCH204")
    method = F.when(d % 2 == 0, "DIRECT_GRAPH_RELATION").otherwise("EXACT_SUBJECT")
    graph, proof = F.coalesce(F.col("toxic") == 1, F.lit(False)), d % 10 == 0
    return rows.select("doc_id", H.agreement(F.lit("ARCH101"), semantic, decided, method).alias("agreement"), H.decide(proof, graph, decided.isNotNull()).alias("decision"), H.reasons(graph=graph, proof=proof).alias("reasons"))


@query(
    """SELECT doc_id, round(1 / (1 + exp(-(0.25 + (n_chars - 1000) / 2000.0::DOUBLE * 0.5 + (coalesce(quality, 1)::DOUBLE - 0.8) / 0.4 * 1.5 + CASE WHEN quality IS NULL THEN -0.7 ELSE 0 END))), 9) AS score FROM documents LEFT JOIN labels USING (doc_id)"""
)
def policy_score(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    values = [(F.col("n_chars"), 1000, 1000, 2000, 0.5, 0.0), (F.col("quality"), 1, 0.8, 0.4, 1.5, -0.7)]
    return rows.select("doc_id", F.round(H.policy_score(values, 0.25), 9).alias("score"))


@query("""SELECT doc_id, feature, value, value IS NOT NULL AS available FROM (SELECT doc_id, 'n_chars' AS feature, n_chars::DOUBLE AS value FROM documents UNION ALL SELECT doc_id, 'quality', quality::DOUBLE FROM documents LEFT JOIN labels USING (doc_id))""")
def feature_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return H.unpivot_features(rows, "doc_id", ["n_chars", "quality"])


@query(
    """WITH RECURSIVE s AS (SELECT o_custkey, o_orderkey, floor(o_totalprice)::BIGINT AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
t AS (SELECT o_custkey, o_orderkey, size, r, size <= 900000 AS kept, 900000 - CASE WHEN size <= 900000 THEN size ELSE 0 END AS room FROM s WHERE r = 1
 UNION ALL SELECT s.o_custkey, s.o_orderkey, s.size, s.r, s.size <= t.room, t.room - CASE WHEN s.size <= t.room THEN s.size ELSE 0 END FROM t JOIN s ON s.o_custkey = t.o_custkey AND s.r = t.r + 1)
SELECT o_custkey, o_orderkey, size FROM t WHERE kept"""
)
def greedy_budget(spark, sf_dir):
    return H.trim(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], F.floor("o_totalprice"), 900_000)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS occurrences FROM events GROUP BY ALL")
def hourly_edges(spark, sf_dir):
    from plumbline.streaming.edges import windowed_edges

    return windowed_edges(table(spark, sf_dir, "events")).drop("users")


@query("""SELECT o_orderpriority AS "group", bool_and(o_orderkey % 997 > 0) AS valid, bool_and(o_orderkey % 997 > 0 AND o_orderkey % 3 < 3) AS complete, count(*)::BIGINT AS files FROM orders GROUP BY 1""")
def build_completeness(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("group"), F.when(k % 997 == 0, "ERROR").otherwise("PARSED").alias("status"), F.lit(0).alias("errors"))
    return R.completeness(rows)


@query("SELECT s_suppkey AS id, 'r' || n_regionkey AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def granularity_climb(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.lit("METHOD").alias("kind"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("CLASS"), F.lit(None).cast("string"))
    return R.at_granularity(s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("node")), n.union(r), "CLASS")


@query(r"""WITH h AS (SELECT DISTINCT replace(regexp_extract(url, '://([^/?#]*)', 1), '-', '') AS p FROM pages), x AS (SELECT DISTINCT array_to_string(str_split(p, '.')[1:k], '.') AS package FROM h, LATERAL (SELECT unnest(range(1, len(str_split(p, '.')) + 1)) AS k))
SELECT package, CASE WHEN package LIKE '%.%' THEN regexp_replace(package, '\.[^.]*$', '') END AS parent FROM x""")
def package_hierarchy(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_extract("url", "://([^/?#]*)", 1), "-", "").alias("package"))
    return R.package_prefixes(rows)
