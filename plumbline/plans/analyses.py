"""Queries of analysis coverage and of evidence packs, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.operators import orchestration as O
from plumbline.operators import packs as P

from .adapters import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# -- coverage -------------------------------------------------------------------------------------------------------

#: Files and bytes that an analysis of these queries takes in.
FILES, BYTES = 6, 180

_COVERAGE_SQL = f"""WITH line AS (SELECT l_orderkey AS snapshot, l_partkey AS path, l_quantity AS size, l_extendedprice AS price, l_tax, l_discount, l_returnflag,
    CASE o_orderstatus WHEN 'F' THEN 'JAVA' WHEN 'O' THEN 'TYPESCRIPT' ELSE 'PYTHON' END AS language, CASE l_returnflag WHEN 'A' THEN 'SEC002' WHEN 'N' THEN 'SEC003' ELSE 'SEC009' END AS rule,
    row_number() OVER w AS place, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)),
seen AS (SELECT * FROM line WHERE place <= {FILES} AND total <= {BYTES}),
code AS (SELECT snapshot, 'SOURCE_INTAKE_LIMIT' AS code FROM line WHERE place > {FILES} OR total > {BYTES}
  UNION SELECT snapshot, CASE WHEN l_discount = 0 THEN 'UNSUPPORTED_LANGUAGE' ELSE 'SOURCE_PARSE_ERROR' END FROM seen WHERE l_discount = 0 OR (l_tax = 0 AND l_returnflag = 'R')
  UNION SELECT snapshot, 'SOURCE_UNAVAILABLE' FROM line WHERE snapshot NOT IN (SELECT snapshot FROM seen WHERE l_discount <> 0 AND NOT (l_tax = 0 AND l_returnflag = 'R'))),
refused AS (SELECT DISTINCT snapshot FROM seen GROUP BY snapshot, path HAVING count(*) > 1),
rule AS (SELECT snapshot, rule, any_value(language) AS language, count(DISTINCT path) FILTER (l_tax > 0.05) AS found, bool_or(price > 90000) AS broke,
    any_value(language) = 'JAVA' AND rule IN ('SEC002', 'SEC003') OR any_value(language) = 'TYPESCRIPT' AND rule IN ('SEC002', 'SEC009') AS supported FROM line GROUP BY snapshot, rule),
units AS (SELECT snapshot, count(*) AS units FROM seen WHERE l_discount <> 0 AND NOT (l_tax = 0 AND l_returnflag = 'R') GROUP BY snapshot),
judged AS (SELECT *, CASE WHEN snapshot IN (SELECT snapshot FROM refused) THEN 'REFUSED' WHEN NOT supported THEN 'CONTRACT_ONLY'
    WHEN broke OR snapshot IN (SELECT snapshot FROM code) THEN 'FAILED' ELSE 'SUPPORTED_PARTIAL_V2_SCOPE' END AS status FROM rule),
every AS (SELECT * FROM code UNION SELECT snapshot, 'PARTIAL_ANALYSIS' FROM line UNION SELECT snapshot, 'UNSUPPORTED_RULE' FROM rule WHERE NOT supported
  UNION SELECT snapshot, 'DETECTOR_ERROR' FROM rule WHERE supported AND broke AND snapshot NOT IN (SELECT snapshot FROM code)),
told AS (SELECT snapshot, string_agg(code, ',' ORDER BY code) AS diagnostics FROM every GROUP BY snapshot),
coverage AS (SELECT snapshot, rule, supported, status = 'SUPPORTED_PARTIAL_V2_SCOPE' AS evaluated, status, coalesce(units, 0)::BIGINT AS units, CASE WHEN status = 'SUPPORTED_PARTIAL_V2_SCOPE' THEN found ELSE 0 END AS findings,
    CASE WHEN status = 'REFUSED' THEN 'DUPLICATE_SOURCE' ELSE diagnostics END AS diagnostics FROM judged JOIN told USING (snapshot) LEFT JOIN units USING (snapshot))"""


def _coverage(spark, sf_dir) -> DataFrame:
    """An order is a snapshot whose status tells its language; its lines are sources, and each asks for the rule of its flag. No discount
    makes it another language, a returned line without tax does not parse, a high tax is a finding, a high price breaks the detector."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    code = lambda column, **names: F.coalesce(*[F.when(F.col(column) == k, v) for k, v in names.items()])
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    language = F.coalesce(code("o_orderstatus", F="JAVA", O="TYPESCRIPT"), F.lit("PYTHON"))
    lines = lines.select(
        F.col("l_orderkey").alias("snapshot"), (F.row_number().over(order) - 1).alias("seq"), F.col("l_partkey").alias("path"), F.col("l_quantity").alias("size"), language.alias("own"),
        F.when(F.col("l_discount") != 0, language).otherwise("JSON").alias("language"), F.when((F.col("l_tax") == 0) & (F.col("l_returnflag") == "R"), "SOURCE_PARSE_ERROR").alias("problem"),
        F.coalesce(code("l_returnflag", A="SEC002", N="SEC003"), F.lit("SEC009")).alias("rule"), F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("price"),
    )
    supported = spark.createDataFrame([("JAVA", "SEC002"), ("JAVA", "SEC003"), ("TYPESCRIPT", "SEC002"), ("TYPESCRIPT", "SEC009")], "language string, rule string")
    return O.coverage(
        lines.select("snapshot", F.col("own").alias("language"), "rule"), F.broadcast(supported), lines.select("snapshot", "seq", "path", "language", "size", "problem"),
        lines.filter("tax > 0.05").select("snapshot", "rule", F.col("path").alias("finding")), lines.filter("price > 90000").select("snapshot", "rule"), FILES, BYTES,
    )


@query(f"{_COVERAGE_SQL} SELECT * FROM coverage")
def rule_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir)


@query(
    f"""{_COVERAGE_SQL} SELECT snapshot, string_agg(rule, ',' ORDER BY rule) AS requested_rules, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (evaluated), '') AS analyzed_rules,
coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (findings > 0), '') AS applicable_rules, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (NOT evaluated), '') AS unsupported_rules,
sum(findings)::BIGINT AS findings, any_value(diagnostics) AS diagnostics FROM coverage GROUP BY snapshot"""
)
def analysis_results(spark, sf_dir):
    return O.results(_coverage(spark, sf_dir))


# -- packs ----------------------------------------------------------------------------------------------------------

_LANES = ", ".join(f"coalesce(sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT), 0)::VARCHAR" for i in range(P.LANES))


def _level_sql(name: str, packs: str, below: str) -> str:
    """A level of packs over what it holds: below has (pack, h, item, n), n items below h."""
    return f"""{name} AS (SELECT p.pack, any_value(p.parent) AS parent, count(*) FILTER (item) AS items, count(*) FILTER (NOT item) AS children, coalesce(sum(n), 0)::BIGINT AS below,
  sha256(concat_ws('|', count(*) FILTER (item), count(*) FILTER (NOT item), {_LANES})) AS fingerprint FROM ({packs}) p LEFT JOIN ({below}) b ON b.pack = p.pack GROUP BY p.pack)"""


def _up(name: str) -> str:
    return f"SELECT parent AS pack, sha256('pack:' || fingerprint) AS h, false AS item, below AS n FROM {name}"


_PACKS_SQL = ",\n".join([
    "WITH item AS (SELECT 'order:' || l_orderkey AS pack, sha256('item:' || concat_ws('|', l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus)) AS h, true AS item, 1 AS n FROM lineitem)",
    _level_sql("l3", "SELECT 'order:' || o_orderkey AS pack, 'customer:' || o_custkey AS parent FROM orders JOIN customer ON o_custkey = c_custkey", "SELECT * FROM item"),
    _level_sql("l2", "SELECT 'customer:' || c_custkey AS pack, 'nation:' || c_nationkey AS parent FROM customer", _up("l3")),
    _level_sql("l1", "SELECT 'nation:' || n_nationkey AS pack, 'region:' || n_regionkey AS parent FROM nation", _up("l2")),
    _level_sql("l0", "SELECT 'region:' || r_regionkey AS pack, NULL AS parent FROM region", _up("l1")),
])


def _tree(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lines are the items of packs of their orders, these of customers, nations and regions. Orders of no customer are not in it."""
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").join(customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    parts = orders.select(name("order", "o_orderkey").alias("pack"), name("customer", "o_custkey").alias("parent"))
    parts = parts.union(customer.select(name("customer", "c_custkey"), name("nation", "c_nationkey")))
    parts = parts.union(table(spark, sf_dir, "nation").select(name("nation", "n_nationkey"), name("region", "n_regionkey")))
    parts = parts.union(table(spark, sf_dir, "region").select(name("region", "r_regionkey"), F.lit(None).cast("string")))
    columns = ("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    items = table(spark, sf_dir, "lineitem").select(name("order", "l_orderkey").alias("pack"), F.concat_ws("|", *columns).alias("content"), "l_returnflag", "l_discount")
    return items, parts


@query(f"{_PACKS_SQL}\n" + " UNION ALL ".join(f"SELECT pack, parent, {i} AS level, items, children, below, fingerprint FROM l{i}" for i in range(4)))
def evidence_packs(spark, sf_dir):
    items, parts = _tree(spark, sf_dir)
    return P.fingerprints(items.select("pack", "content"), parts)


@query(
    """WITH gone AS (SELECT DISTINCT o_orderkey, c_custkey, n_nationkey, n_regionkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE l_returnflag = 'R' AND l_discount = 0), changed AS (SELECT 'order:' || o_orderkey AS pack FROM gone UNION SELECT 'customer:' || c_custkey FROM gone UNION SELECT 'nation:' || n_nationkey FROM gone UNION SELECT 'region:' || n_regionkey FROM gone),
every AS (SELECT 'order:' || o_orderkey AS pack FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT 'customer:' || c_custkey FROM customer UNION SELECT 'nation:' || n_nationkey FROM nation UNION SELECT 'region:' || r_regionkey FROM region)
SELECT pack, CASE WHEN c.pack IS NULL THEN 'SAME' ELSE 'CHANGED' END AS status FROM every LEFT JOIN changed c USING (pack)"""
)
def changed_packs(spark, sf_dir):
    """What changes if returned lines without discount are taken out. The SQL asks which packs hold such a line."""
    items, parts = _tree(spark, sf_dir)
    kept = items.filter(~((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0)))
    return P.changes(P.fingerprints(items.select("pack", "content"), parts), P.fingerprints(kept.select("pack", "content"), parts))
