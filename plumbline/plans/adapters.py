"""Relations for the operators, made from the star-schema and text tables by SQL that Spark and DuckDB both run.

Each entry is a SELECT over the tables and earlier entries. In Spark an entry becomes a DataFrame over temporary
views; in an oracle the entries become common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

RELATIONS = {
    # components are nations, layers are regions
    "component": """SELECT n_name AS v, r_name AS layer, CASE WHEN n_nationkey % 3 = 0 THEN 'core' ELSE 'edge' END AS module,
        CAST(n_nationkey AS BIGINT) AS nationkey FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "dep": """SELECT a.n_name AS src, b.n_name AS dst,
        CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'N' THEN 'IMPORTS' ELSE 'USES' END AS relation,
        CAST(count(*) AS BIGINT) AS occurrences
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey
        GROUP BY a.n_name, b.n_name, l_returnflag""",
    # a sparser graph on the same components: only some pairs
    "arc": """SELECT DISTINCT src, dst FROM dep JOIN component a ON src = a.v JOIN component b ON dst = b.v
        WHERE (a.nationkey * 7 + b.nationkey * 3 + a.nationkey * b.nationkey) % 11 < 2""",
    # users follow each other within an event type
    "step": """SELECT user_id AS src, event_id, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst FROM events""",
    "ranked_step": """SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY event_id) AS rn FROM step WHERE dst IS NOT NULL AND src <> dst""",
    "sparse": """SELECT DISTINCT src, dst FROM ranked_step WHERE rn <= 1""",
    "twofold": """SELECT DISTINCT src, dst FROM ranked_step WHERE rn <= 1 + src % 2""",
    # all successors, and those of the earlier and the later half of the events
    "follow": """SELECT DISTINCT src, dst FROM step WHERE dst IS NOT NULL AND src <> dst""",
    "follow_earlier": """SELECT DISTINCT src, dst FROM step WHERE dst IS NOT NULL AND src <> dst AND event_id <= (SELECT avg(event_id) FROM events)""",
    "follow_later": """SELECT DISTINCT src, dst FROM step WHERE dst IS NOT NULL AND src <> dst AND event_id > (SELECT avg(event_id) FROM events)""",
    # all pairs of components that depend
    "link": """SELECT DISTINCT src, dst FROM dep""",
    "user_vertex": """SELECT DISTINCT user_id AS v FROM events""",
    "file": """SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*/?', '') AS path,
        regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/.*$', '') AS host FROM pages""",
    # programs: a user is a function, visits are its values, places (a dozen visits and an event type) the nodes of its control flow
    "visit": """SELECT user_id AS f, event_id AS n, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
        CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'view' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS code FROM events""",
    "place": """SELECT f, n, event_type, value, k, rn, CAST((rn - rn % 12) * 8 + code AS BIGINT) AS spot FROM visit""",
    "path_step": """SELECT f, n, event_type, value, k, rn, spot, lead(n) OVER (PARTITION BY f ORDER BY rn) AS next_n, lead(value) OVER (PARTITION BY f ORDER BY rn) AS next_value,
        lead(event_type) OVER (PARTITION BY f ORDER BY rn) AS next_type, lead(spot) OVER (PARTITION BY f ORDER BY rn) AS next_spot, lag(n) OVER (PARTITION BY f ORDER BY rn) AS last_n FROM place""",
    "control": """SELECT DISTINCT f AS function, spot AS src, next_spot AS dst FROM path_step WHERE next_spot IS NOT NULL AND next_spot <> spot""",
    "written": """SELECT DISTINCT f AS function, spot AS node, CASE event_type WHEN 'purchase' THEN 'basket' ELSE 'name' END AS variable FROM place WHERE event_type IN ('purchase', 'signup')""",
    # a value goes on to the next visit if that one is worth more; a purchase before a purchase is a call of the function that it names
    "value_flow": """SELECT f AS function, n AS src, next_n AS dst, next_type FROM path_step WHERE next_value > value""",
    "call_site": """SELECT f AS function, n AS site, k AS callee, n, last_n, next_n FROM path_step WHERE event_type = 'purchase' AND next_type = 'purchase'""",
    # a customer is a file, whose orders are declarations around those of their lines
    "outline": """SELECT custkey AS file, row_number() OVER (PARTITION BY custkey ORDER BY orderkey, line, partkey, suppkey, price, shipped) AS position, custkey * 100000 + row_number() OVER (PARTITION BY custkey ORDER BY orderkey, line, partkey, suppkey, price, shipped) AS declaration,
        orderkey, line, name, arity, asked FROM (
        SELECT o_custkey AS custkey, o_orderkey AS orderkey, 0 AS line, 0 AS partkey, 0 AS suppkey, 0.0 AS price, o_orderdate AS shipped, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS name, CAST(lines AS INT) AS arity, -1 AS asked
        FROM orders JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) AS c ON l_orderkey = o_orderkey
        UNION ALL SELECT o_custkey, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag, CAST(round(l_tax * 100) AS INT), CAST(round(l_discount * 100) AS INT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS u""",
    # the part that a part was first bought with is its base; one brand is withdrawn
    "repository": """SELECT p_partkey AS repository, base, CASE WHEN p_size > 45 THEN 'large' ELSE 'usual' END AS family, CASE WHEN p_type = 'PROMO' THEN 'TEST' ELSE 'TRAIN' END AS split FROM part
        LEFT JOIN (SELECT a.l_partkey AS p, min(b.l_partkey) AS base FROM lineitem a JOIN (SELECT l_partkey AS fp, min(l_orderkey) AS fo FROM lineitem GROUP BY l_partkey) AS f ON a.l_partkey = fp AND a.l_orderkey = fo
          JOIN lineitem b ON b.l_orderkey = fo AND b.l_partkey <> fp GROUP BY a.l_partkey) AS x ON p = p_partkey WHERE p_brand <> 'Brand#2'""",
    # predictions against labels: text length predicts quality, unlabelled documents are unknown
    "judged": """SELECT d.doc_id AS case_id, source AS family, lang AS language, quality, toxic, n_chars,
        CASE WHEN quality IS NULL THEN 'UNKNOWN' WHEN quality = 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS truth,
        CASE WHEN n_chars > 6000 THEN 'ABSTAIN' WHEN n_chars > 900 THEN 'POSITIVE' WHEN n_chars > 300 THEN 'NEGATIVE' END AS prediction
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "decided": """SELECT case_id, family, language, truth, CASE WHEN prediction = 'POSITIVE' THEN 'SUPPORTED' WHEN prediction = 'NEGATIVE' THEN 'NOT_SUPPORTED'
        WHEN prediction = 'ABSTAIN' THEN 'INSUFFICIENT' ELSE 'NOT_APPLICABLE' END AS decision FROM judged""",
}

# name -> (function, SQL) over a part of the tables: not registered, tests compare the two
PARTS: dict = {}
_PART_SQL: dict[str, tuple[str, tuple[str, ...], bool]] = {}

#: Queries whose SQL is that of their part with the relation or the condition that made it a part replaced.
WHOLE = {
    **dict.fromkeys("graph_candidates dependency_matrix module_cohesion topology_top_k layer_groups direction_evidence betweenness".split(), {"arc": "link"}),
    **dict.fromkeys("strong_components component_summary pagerank_six_rounds k_hop context_selection".split(), {"twofold": "follow", "sparse": "follow"}),
    "edge_difference": {"twofold": "follow_later", "sparse": "follow_earlier"},
    "path_lengths": {"twofold": "follow", "sparse": "follow", " WHERE v % 10 = 3": ""},
    "resolve_status": {" WHERE page_id % 9 = 0": ""},
    "resolution_ladder": {" WHERE o_orderkey % 20 = 1": ""},
    "arity_join": {" WHERE o_orderkey % 10 = 3": ""},
    "model_violations": {" WHERE o_orderkey % 50 = 7": ""},
    "evidence_alignment": {" WHERE c_custkey % 15 = 0": ""},
    "kappa_rater_pairs": {" WHERE o_custkey % 10 = 1": ""},
    "grouped_split": {" WHERE o_orderkey % 5 = 0": ""},
    "scoped_extras": {" WHERE o_orderkey % 6 = 0": ""},
    "role_arbitration": {" WHERE c_custkey % 4 = 1": ""},
}


def part(sql: str, *names: str, recursive: bool = False):
    """Keeps the SQL of a part with the function that reads the same part. The registered query of the name reads all."""

    def add(f):
        PARTS[f.__name__] = f, oracle(sql, *names, recursive=recursive)
        _PART_SQL[f.__name__] = sql, names, recursive
        return f

    return add


def whole_oracles() -> dict[str, str]:
    """The SQL of the queries of WHOLE, over all rows."""
    out = {}
    for name, changes in WHOLE.items():
        sql, names, recursive = _PART_SQL[f"{name}_part"]
        for old, new in changes.items():
            if old.startswith(" "):
                sql = sql.replace(old, new)
            else:
                sql, names = re.sub(rf"\b{old}\b", new, sql), tuple(dict.fromkeys(new if n == old else n for n in names))
        out[name] = oracle(sql, *names, recursive=recursive)
    return out


def needed(*names: str) -> list[str]:
    """The relations that names rest on, in order, themselves included."""
    out: list[str] = []

    def add(name: str) -> None:
        for other in RELATIONS:
            if other != name and re.search(rf"\b{other}\b", RELATIONS[name]):
                add(other)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation as a DataFrame. Tables are read as views under their own names."""
    order = needed(name)
    text = " ".join(RELATIONS[x] for x in order)
    for table in TABLES:
        if re.search(rf"\b{table}\b", text):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    parts = ", ".join(f"{x} AS ({RELATIONS[x]})" for x in order[:-1])
    return spark.sql((f"WITH {parts} " if parts else "") + RELATIONS[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(query: str, *names: str, recursive: bool = False) -> str:
    """query over relations, as one DuckDB statement. A query may go on with its own common table expressions."""
    parts = ",\n".join(f"{x} AS ({RELATIONS[x]})" for x in needed(*names))
    query = query.strip()
    more = query.startswith(",")
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{'' if more or not parts else chr(10)}{query}" if parts else query
