"""Queries of data flow, dominance, guards, calls, declarations, packs, lineage and manifests over relations made from the tables
(see adapters.RELATIONS), with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.operators import dataflow as D
from plumbline.operators import declarations as C
from plumbline.operators import lineage as L
from plumbline.operators.graph import stored
from plumbline.operators.interprocedural import MAX_CALL_DEPTH
from plumbline.sources import manifests as M

from .adapters import oracle, relation, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, *names: str, recursive: bool = True):
    """Registers a query under its function's name, with its oracle over the named relations."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql, *names, recursive=recursive)
        return f

    return add


REACHING_SQL = """reach AS (SELECT w.function, e.dst AS node, w.variable, w.node AS definition FROM written w JOIN control e ON e.function = w.function AND e.src = w.node
  UNION SELECT r.function, e.dst, r.variable, r.definition FROM reach r JOIN control e ON e.function = r.function AND e.src = r.node
  WHERE NOT EXISTS (SELECT 1 FROM written w WHERE w.function = r.function AND w.node = r.node AND w.variable = r.variable))"""


@query(f", {REACHING_SQL} SELECT function, node, variable, definition FROM reach", "control", "written")
def reaching_definitions(spark, sf_dir):
    return D.reaching_definitions(relation(spark, sf_dir, "control"), relation(spark, sf_dir, "written"))


@query(
    f""", {REACHING_SQL}, used AS (SELECT DISTINCT f AS function, spot AS node, CASE event_type WHEN 'view' THEN 'basket' ELSE 'name' END AS variable FROM place WHERE event_type IN ('view', 'click'))
SELECT function, variable, definition, node FROM reach JOIN used USING (function, node, variable)""",
    "control", "written", "place",
)
def definition_uses(spark, sf_dir):
    """The places that view a basket or click with a name, and the places that may have written it."""
    reaching = D.reaching_definitions(relation(spark, sf_dir, "control"), relation(spark, sf_dir, "written"))
    event = F.col("event_type")
    used = relation(spark, sf_dir, "place").filter(event.isin("view", "click"))
    used = used.select(F.col("f").alias("function"), F.col("spot").alias("node"), F.when(event == "view", "basket").otherwise("name").alias("variable"))
    return D.definition_uses(reaching, used)


@query(
    """, reach AS (SELECT f, n AS node, n AS source, 0::BIGINT AS sanitized, 0 AS steps FROM visit WHERE event_type = 'error'
  UNION SELECT r.f, v.dst, r.source, r.sanitized | CASE v.next_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END, r.steps + 1 FROM reach r JOIN value_flow v ON v.function = r.f AND v.src = r.node WHERE r.steps < 64)
SELECT f AS function, node, rule, source, CASE WHEN bool_and((sanitized >> rule) & 1 = 1) THEN 'SANITIZED' ELSE 'TAINTED' END AS state, count(DISTINCT sanitized)::BIGINT AS ways, min(steps)::INTEGER AS steps
FROM reach JOIN visit v ON v.f = reach.f AND v.n = reach.node, (VALUES (0), (1)) AS x(rule) WHERE v.event_type = 'click' GROUP BY ALL""".replace("SELECT f AS function, node", "SELECT reach.f AS function, node"),
    "visit", "value_flow",
)
def flow_states(spark, sf_dir):
    """What errors send to clicks, as values rise from visit to visit: a view makes it safe for rule 0, a signup for rule 1."""
    step = F.when(F.col("next_type") == "view", 1).when(F.col("next_type") == "signup", 2).otherwise(0).cast("long")
    links = relation(spark, sf_dir, "value_flow").select("function", "src", "dst", step.alias("sanitizes"))
    visits = relation(spark, sf_dir, "visit").select(F.col("f").alias("function"), F.col("n").alias("node"), "event_type")
    sinks = visits.filter("event_type = 'click'").select("function", "node", F.explode(F.array(F.lit(0), F.lit(1))).alias("rule"))
    return D.sink_states(D.carried_states(links, visits.filter("event_type = 'error'").select("function", "node")), sinks)


@query(
    """, entry AS (SELECT f AS function, spot AS node FROM place WHERE rn = 1), every AS (SELECT function, node FROM entry UNION SELECT function, dst FROM control),
without AS (SELECT e.function, r.node AS gone, e.node FROM entry e JOIN every r ON r.function = e.function AND r.node <> e.node
  UNION SELECT w.function, w.gone, c.dst FROM without w JOIN control c ON c.function = w.function AND c.src = w.node AND c.dst <> w.gone),
dom AS (SELECT a.function, a.node, b.node AS dominator FROM every a JOIN every b ON a.function = b.function LEFT JOIN entry e ON e.function = a.function AND e.node = b.node
  WHERE a.node = b.node OR e.node IS NOT NULL OR NOT EXISTS (SELECT 1 FROM without w WHERE w.function = a.function AND w.gone = b.node AND w.node = a.node)),
own AS (SELECT d.* FROM dom d LEFT JOIN entry e ON e.function = d.function AND e.node = d.node WHERE e.node IS NULL OR d.dominator = d.node),
deep AS (SELECT function, node, count(*) - 1 AS depth FROM own GROUP BY ALL)
SELECT o.function, o.node, arg_max(o.dominator, p.depth) FILTER (o.dominator <> o.node) AS idom, max(p.depth)::BIGINT AS depth
FROM own o JOIN deep p ON p.function = o.function AND p.node = o.dominator GROUP BY o.function, o.node""",
    "control", "place",
)
def immediate_dominators(spark, sf_dir):
    """The SQL takes each place out and asks what is still reached."""
    entries = relation(spark, sf_dir, "place").filter("rn = 1").select(F.col("f").alias("function"), F.col("spot").alias("node"))
    return D.immediate_dominators(D.dominators(relation(spark, sf_dir, "control"), entries))


@query(
    """, entry AS (SELECT f AS function, spot AS node FROM place WHERE rn = 1), kinds(variable, kind) AS (VALUES ('basket', 'PATH_CONFINEMENT'), ('name', 'SSRF_ALLOWLIST')),
gate AS (SELECT DISTINCT f AS function, spot AS src, next_spot AS dst, CASE next_type WHEN 'click' THEN 'basket' ELSE 'name' END AS variable FROM path_step WHERE event_type = 'view' AND next_type IN ('click', 'error') AND next_spot <> spot),
walk AS (SELECT function, node, variable, kind, CASE WHEN false THEN '' END AS fresh, false AS ever FROM entry, kinds
  UNION SELECT w.function, c.dst, w.variable, w.kind, CASE WHEN g.src IS NOT NULL THEN g.src || '>' || g.dst WHEN x.node IS NULL THEN w.fresh END, w.ever OR g.src IS NOT NULL
  FROM walk w JOIN control c ON c.function = w.function AND c.src = w.node LEFT JOIN gate g ON g.function = c.function AND g.src = c.src AND g.dst = c.dst AND g.variable = w.variable
  LEFT JOIN written x ON x.function = w.function AND x.node = w.node AND x.variable = w.variable),
sink AS (SELECT DISTINCT f AS function, spot AS node, CASE event_type WHEN 'signup' THEN 'basket' ELSE 'name' END AS variable FROM place WHERE event_type IN ('signup', 'purchase'))
SELECT s.function, s.node::VARCHAR AS node, s.variable, k.kind, CASE k.kind WHEN 'PATH_CONFINEMENT' THEN 'SEC004' ELSE 'SEC006' END AS rule_id,
  CASE WHEN count(w.node) = 0 THEN 'UNREACHABLE' WHEN bool_and(w.fresh IS NOT NULL) THEN 'PROVEN' WHEN bool_and(w.ever) THEN 'MODIFIED' ELSE 'UNGUARDED' END AS verdict, count(DISTINCT w.fresh)::BIGINT AS guards
FROM sink s JOIN kinds k USING (variable) LEFT JOIN walk w ON w.function = s.function AND w.node = s.node AND w.variable = s.variable GROUP BY ALL""",
    "control", "written", "place", "path_step",
)
def proven_sinks(spark, sf_dir):
    """Signups use the basket and purchases the name; a view that leads to a click or an error proves them on that way. The SQL
    walks with the state of the guard."""
    place, step = relation(spark, sf_dir, "place"), relation(spark, sf_dir, "path_step")
    kind = F.when(F.col("variable") == "basket", "PATH_CONFINEMENT").otherwise("SSRF_ALLOWLIST").alias("kind")
    node = place.select(F.col("f").alias("function"), F.col("spot").alias("node"), "event_type", "rn")
    guards = step.filter("event_type = 'view' AND next_type IN ('click', 'error') AND next_spot <> spot")
    guards = guards.select(F.col("f").alias("function"), F.col("spot").alias("src"), F.col("next_spot").alias("dst"), F.when(F.col("next_type") == "click", "basket").otherwise("name").alias("variable"))
    sinks = node.filter("event_type IN ('signup', 'purchase')").select("function", "node", F.when(F.col("event_type") == "signup", "basket").otherwise("name").alias("variable"))
    return D.proven_sinks(relation(spark, sf_dir, "control"), node.filter("rn = 1").select("function", "node"), relation(spark, sf_dir, "written"), guards.select("*", kind), sinks.select("*", kind))


def _program(spark, sf_dir) -> D.Program:
    """Parameters are the first three visits, signups return, errors are sources and clicks sinks; a call hands over its own
    visit and the one before, and gives its result to the next."""
    visit = relation(spark, sf_dir, "visit").select(F.col("f").alias("function"), F.col("n").alias("node"), "event_type", "rn")
    of = lambda kind: visit.filter(F.col("event_type") == kind).select("function", "node")
    sites = relation(spark, sf_dir, "call_site")
    arg = lambda position, node: sites.select("function", "site", "callee", F.lit(position).alias("position"), F.col(node).alias("node")).filter("node is not null")
    return D.Program(
        flows=relation(spark, sf_dir, "value_flow"), params=visit.filter("rn <= 3").select("function", (F.col("rn") - 1).cast("int").alias("position"), "node"), returns=of("signup"),
        args=arg(0, "n").union(arg(1, "last_n")), results=sites.select("function", "site", "callee", F.col("next_n").alias("node")), sources=of("error"), sinks=of("click").withColumn("rule", F.lit("SEC002")),
    )


def _reach_sql(deepest: int) -> str:
    """values at depths 0 to deepest, one recursive expression each; reach<d> holds what takes d calls or fewer."""
    out = [
        """, param AS (SELECT f AS function, (rn - 1)::VARCHAR AS position, n AS node FROM visit WHERE rn <= 3), given AS (SELECT f AS function, n AS node FROM visit WHERE event_type = 'signup'),
arg AS (SELECT function, site, callee, '0' AS position, n AS node FROM call_site UNION ALL SELECT function, site, callee, '1', last_n FROM call_site WHERE last_n IS NOT NULL),
step0 AS (SELECT DISTINCT function, src, dst FROM value_flow),
seed0 AS (SELECT function, function AS home, 'P' AS kind, position AS origin, node FROM param UNION ALL SELECT f, f, 'S', n::VARCHAR, n FROM visit WHERE event_type = 'error')"""
    ]
    for d in range(deepest + 1):
        if d:
            out.append(f"""step{d} AS (SELECT function, src, dst FROM step0 UNION SELECT a.function, a.node, c.next_n FROM arg a JOIN call_site c ON c.function = a.function AND c.site = a.site
  JOIN back{d - 1} b ON b.function = a.callee AND b.kind = 'P' AND b.origin = a.position),
seed{d} AS (SELECT * FROM seed0 UNION SELECT c.function, b.home, b.kind, b.origin, c.next_n FROM back{d - 1} b JOIN call_site c ON c.callee = b.function WHERE b.kind = 'S')""")
        out.append(f"""reach{d} AS (SELECT * FROM seed{d} UNION SELECT r.function, r.home, r.kind, r.origin, s.dst FROM reach{d} r JOIN step{d} s ON s.function = r.function AND s.src = r.node),
back{d} AS (SELECT DISTINCT r.function, r.home, r.kind, r.origin FROM reach{d} r JOIN given g ON g.function = r.function AND g.node = r.node)""")
    return ",\n".join(out)


DEEPEST = MAX_CALL_DEPTH + 1
_SINK_SQL = ",\n".join(
    f"sink{d} AS (SELECT r.function, r.home, r.kind, r.origin, r.function AS sink_function, r.node AS sink FROM reach{d} r JOIN visit v ON v.f = r.function AND v.n = r.node WHERE v.event_type = 'click'"
    + (f" UNION SELECT r.function, r.home, r.kind, r.origin, s.sink_function, s.sink FROM reach{d} r JOIN arg a ON a.function = r.function AND a.node = r.node JOIN sink{d - 1} s ON s.function = a.callee AND s.kind = 'P' AND s.origin = a.position" if d else "")
    + ")"
    for d in range(DEEPEST + 1)
)


@query(
    f"""{_reach_sql(DEEPEST)}, every AS ({' UNION ALL '.join(f'SELECT *, {d} AS depth FROM back{d}' for d in range(DEEPEST + 1))})
SELECT function, home, kind, origin, min(depth)::INTEGER AS depth FROM every GROUP BY ALL""",
    "visit", "value_flow", "call_site",
)
def function_summaries(spark, sf_dir):
    """What functions give back of their parameters and of sources, and through how many calls."""
    program = _program(spark, sf_dir)
    return D.summaries(program, D.value_reach(program))[0]


@query(
    f"""{_reach_sql(DEEPEST)}, {_SINK_SQL}, every AS ({' UNION ALL '.join(f"SELECT home, origin, sink_function, sink, {d} AS depth FROM sink{d} WHERE kind = 'S'" for d in range(DEEPEST + 1))})
SELECT home, origin, sink_function, sink, 'SEC002' AS rule, min(depth)::INTEGER AS depth, CASE WHEN min(depth) > {MAX_CALL_DEPTH} THEN 'UNKNOWN' ELSE 'TAINTED' END AS state
FROM every GROUP BY home, origin, sink_function, sink""",
    "visit", "value_flow", "call_site",
)
def call_findings(spark, sf_dir):
    """Errors whose value comes to clicks, calls matched with their returns."""
    program = _program(spark, sf_dir)
    return D.findings(D.summaries(program, D.value_reach(program))[1])


# -- declarations ---------------------------------------------------------------------------------------------------


def _outline(spark, sf_dir):
    """The relation outline as declarations and calls. An order's lines are put in order where the order is and travel as its row; the
    order's place among those of its customer then numbers them all."""
    line = table(spark, sf_dir, "lineitem")
    hundredths = lambda c: F.round(F.col(c) * 100).cast("int")
    line = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", F.col("l_returnflag").alias("name"), hundredths("l_tax").alias("arity"), hundredths("l_discount").alias("asked"))
    row = F.struct(*line.columns[1:])
    lines = line.repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("lines"))
    own = lambda c, name: F.transform("lines", lambda x: x[c]).alias(name)
    status = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R").alias("status")
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    orders = stored(orders.select(F.col("o_custkey").alias("file"), "o_orderkey", status, own("name", "names"), own("arity", "arities"), own("asked", "asks")))
    before = W.partitionBy("file").orderBy("o_orderkey").rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.size("names") + 1).over(before), F.lit(0)) + 1
    orders = orders.repartition("file").withColumn("first", first)
    number = (F.col("file") * 100_000 + F.col("position")).alias("declaration")
    every = F.arrays_zip(F.concat(F.array("status"), "names").alias("name"), F.concat(F.array(F.size("arities")), "arities").alias("arity"))
    declarations = orders.select("file", "first", F.size("names").alias("lines"), F.posexplode(every).alias("at", "_")).withColumn("position", F.col("first") + F.col("at"))
    last = F.when(F.col("at") == 0, F.col("first") + F.col("lines")).otherwise(F.col("position"))
    declarations = declarations.select("file", number, F.col("position").alias("start"), last.alias("end"), "_.name", "_.arity")
    calls = orders.select("file", "first", F.posexplode(F.arrays_zip(F.col("names").alias("name"), F.col("asks").alias("asked"))).alias("at", "_")).withColumn("position", F.col("first") + F.col("at") + 1)
    return declarations, calls.select("file", number, "position", "_.name", "_.asked")


@query(
    """, calls AS (SELECT file, declaration AS call, orderkey, name, asked FROM outline WHERE line > 0),
near AS (SELECT c.call, o.declaration AS target, CASE WHEN o.line > 0 THEN 1 ELSE 2 END AS distance FROM calls c JOIN outline o ON o.file = c.file AND o.name = c.name AND o.arity = c.asked AND (o.line = 0 OR o.orderkey = c.orderkey)),
best AS (SELECT call, min(distance) AS distance FROM near GROUP BY call),
told AS (SELECT call, count(*) AS n, list(target ORDER BY target) AS targets FROM near JOIN best USING (call, distance) GROUP BY call)
SELECT call, CASE WHEN n > 1 THEN 'AMBIGUOUS' WHEN n = 1 THEN 'UNAMBIGUOUS_LOCAL' ELSE 'UNRESOLVED' END AS state, coalesce(n, 0)::BIGINT AS candidates, coalesce(array_to_string(targets, ','), '') AS targets FROM calls LEFT JOIN told USING (call)""",
    "outline", recursive=False,
)
def lexical_targets(spark, sf_dir):
    """Each line calls what its order, or else its customer, declares under its flag with its discount as the number of arguments."""
    declarations, lines = _outline(spark, sf_dir)
    calls = lines.withColumnsRenamed({"declaration": "call", "asked": "arity"})
    return C.lexical_targets(calls, declarations, most=None).withColumn("targets", F.array_join("targets", ","))


@query(
    """, base(type, base) AS (SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'c' || c_custkey, c_mktsegment FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
member(type, name, target) AS (SELECT 'n' || s_nationkey, floor(s_acctbal / 1000)::BIGINT, 's' || s_suppkey FROM supplier UNION ALL SELECT c_mktsegment, floor(c_acctbal / 100)::BIGINT, 'c' || c_custkey FROM customer UNION ALL SELECT 'r' || n_regionkey, length(n_name)::BIGINT, 'n' || n_nationkey FROM nation),
up AS (SELECT DISTINCT type, type AS b, 0 AS distance FROM base UNION SELECT u.type, x.base, u.distance + 1 FROM up u JOIN base x ON x.type = u.b),
near AS (SELECT o_orderkey AS call, target, distance FROM orders JOIN up ON up.type = 'c' || o_custkey JOIN member m ON m.type = up.b AND m.name = floor(o_totalprice / 50000)::BIGINT),
best AS (SELECT call, min(distance) AS distance FROM near GROUP BY call), told AS (SELECT call, count(*) AS n, list(target ORDER BY target)[1:4] AS targets FROM near JOIN best USING (call, distance) GROUP BY call)
SELECT o_orderkey AS call, CASE WHEN n > 1 THEN 'AMBIGUOUS' WHEN n = 1 THEN 'EXACT' ELSE 'UNRESOLVED' END AS state, coalesce(n, 0)::BIGINT AS candidates, coalesce(array_to_string(targets, ','), '') AS targets FROM orders LEFT JOIN told ON call = o_orderkey"""
    .replace(", base(", "WITH RECURSIVE base(", 1),
)
def member_targets(spark, sf_dir):
    """Orders call members of their customer's type, which derives from the types of its nation and segment."""
    c, n, s, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier", "orders"))
    of = lambda letter, column: F.concat(F.lit(letter), F.col(column))
    bases = c.select(of("c", "c_custkey").alias("type"), of("n", "c_nationkey").alias("base")).union(c.select(of("c", "c_custkey"), "c_mktsegment")).union(n.select(of("n", "n_nationkey"), of("r", "n_regionkey")))
    members = s.select(of("n", "s_nationkey").alias("type"), F.floor(F.col("s_acctbal") / 1000).alias("name"), of("s", "s_suppkey").alias("target"))
    members = members.union(c.select("c_mktsegment", F.floor(F.col("c_acctbal") / 100), of("c", "c_custkey"))).union(n.select(of("r", "n_regionkey"), F.length("n_name").cast("long"), of("n", "n_nationkey")))
    calls = o.select(F.col("o_orderkey").alias("call"), of("c", "o_custkey").alias("type"), F.floor(F.col("o_totalprice") / 50000).alias("name"), F.lit(0).alias("arity"))
    return C.member_targets(calls, members.withColumn("arity", F.lit(0)), bases).withColumn("targets", F.array_join("targets", ","))


@query(
    """WITH bought AS (SELECT DISTINCT o_custkey AS file, l_suppkey AS fact FROM lineitem JOIN orders ON l_orderkey = o_orderkey), wanted AS (SELECT s_nationkey, count(*) AS wanted FROM supplier WHERE s_acctbal >= 0 GROUP BY s_nationkey),
met AS (SELECT file, s_nationkey, count(*) FILTER (s_acctbal >= 0) AS met, count(*) FILTER (s_acctbal < 0) AS broken FROM bought JOIN supplier ON s_suppkey = fact GROUP BY ALL)
SELECT file, s_nationkey AS pack, CASE WHEN broken > 0 THEN 'INVALIDATED' WHEN met = wanted THEN 'HOLDS' ELSE 'INCOMPLETE' END AS status, met, coalesce(wanted, 0)::BIGINT AS wanted, broken FROM met LEFT JOIN wanted USING (s_nationkey)""",
)
def packs_that_hold(spark, sf_dir):
    """A nation's pack asks for all its suppliers, but for those in debt, which invalidate it."""
    facts = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    asked = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pack"), F.col("s_suppkey").alias("fact"), (F.col("s_acctbal") < 0).alias("invalidates"))
    return C.packs_that_hold(facts.select(F.col("o_custkey").alias("file"), F.col("l_suppkey").alias("fact")), asked)


# -- data sets -------------------------------------------------------------------------------------------------------


@query(
    """, walk AS (SELECT repository, repository AS at_, [repository] AS path, false AS crossed, 'on' AS state, family, split FROM repository
  UNION ALL SELECT w.repository, b.repository, list_append(w.path, b.repository), w.crossed OR b.family <> w.family OR b.split <> w.split,
   CASE WHEN a.base IS NULL THEN 'end' WHEN b.repository IS NULL THEN 'missing' WHEN list_contains(w.path, b.repository) THEN 'cycle' ELSE 'on' END, w.family, w.split
  FROM walk w JOIN repository a ON a.repository = w.at_ LEFT JOIN repository b ON b.repository = a.base WHERE w.state = 'on')
SELECT repository, CASE WHEN bool_or(crossed) THEN 'CROSSING' WHEN bool_or(state = 'missing') THEN 'MISSING' WHEN bool_or(state = 'cycle') THEN 'CYCLE' END AS problem,
 CASE WHEN NOT bool_or(state = 'cycle') THEN count(*) FILTER (state = 'on') - 1 END AS ancestors,
 max(CASE WHEN state = 'cycle' THEN list_min(path[list_position(path, at_):]) END) AS cycle FROM walk GROUP BY repository""",
    "repository",
)
def lineage_problems(spark, sf_dir):
    return L.lineage_problems(relation(spark, sf_dir, "repository"))


@query(
    """WITH line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS place FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
whole AS (SELECT l_orderkey AS manifest, CASE WHEN count(DISTINCT l_linenumber) < count(*) THEN 'REPEATED_KEY' WHEN any_value(o_orderstatus) = 'P' THEN 'JSON' END AS code FROM line GROUP BY l_orderkey),
item AS (SELECT line.*, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS times FROM line JOIN whole ON manifest = l_orderkey WHERE code IS NULL)
SELECT manifest, NULL::INTEGER AS place, code FROM whole WHERE code IS NOT NULL UNION ALL SELECT l_orderkey, place::INTEGER, 'FIELD' FROM item WHERE l_discount = 0
UNION ALL SELECT l_orderkey, place::INTEGER, 'SPLIT' FROM item WHERE l_discount > 0 AND l_returnflag = 'R' UNION ALL SELECT l_orderkey, place::INTEGER, 'PATH' FROM item WHERE l_discount > 0 AND l_quantity > 45
UNION ALL SELECT l_orderkey, place::INTEGER, 'REPEATED_REPOSITORY' FROM item WHERE times > 1""",
)
def manifest_problems(spark, sf_dir):
    """An order is the text of a manifest of its lines. Lines of one number repeat a key of its index; a pending order has text after
    the object; a line without discount names no split, one with a large quantity has a path out of the data set."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.col("l_partkey").cast("string").alias("repository"), F.col("l_suppkey").cast("string").alias("family"),
        F.when(F.col("l_discount") > 0, F.element_at(F.create_map(*map(F.lit, ("A", "TRAIN", "N", "DEV", "R", "HELD"))), F.col("l_returnflag"))).alias("split"),
        F.concat(F.when(F.col("l_quantity") > 45, "../").otherwise("src/"), "l_linestatus", F.lit("/"), "l_partkey").alias("path"),
    )
    orders = rows.groupBy(F.col("l_orderkey").alias("manifest")).agg(F.array_sort(F.collect_list(line)).alias("lines"), F.first("o_orderstatus").alias("status"))
    index = F.array_join(F.transform("lines", lambda x: F.concat(F.lit('"'), x["l_linenumber"], F.lit('":1'))), ",")
    text = F.concat(F.lit('{"repositories":'), F.to_json("lines"), F.lit(',"index":{'), index, F.lit("}}"), F.when(F.col("status") == "P", " pending").otherwise(""))
    return M.load_manifests(orders.select("manifest", text.alias("text")))[1]
