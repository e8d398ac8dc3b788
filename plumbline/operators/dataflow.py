"""Data flow over program graphs that are tables: reaching definitions, states carried along value flow, dominators, guards that
prove sinks, and summaries of functions with matched calls and returns.

All are fixpoints over many functions at once. A round is a few joins on (function, node) with what the round before found new
(semi-naive), and a reliable checkpoint; a loop ends when nothing is new, and nothing but that count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, dropped, stored
from .interprocedural import MAX_CALL_DEPTH, PROOFS
from .ranks import with_rank

#: Fixed value: steps of a path after which a flow is UNKNOWN.
MAX_FLOW_STEPS = 64


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _grown(seen: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """What is known, with what is new; many small tables become one now and then."""
    seen = [*seen, new]
    return [checkpointed(_all(seen))] if len(seen) > 8 else seen


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


# -- definitions --------------------------------------------------------------------------------------------------


def reaching_definitions(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """(function, node, variable, definition): the nodes whose value of variable may be the one that node sees as it is entered.
    edges (function, src, dst) is the control flow; a node of definitions (function, node, variable) writes variable, which
    ends all other definitions of it there (kill)."""
    edges = checkpointed(edges.select("function", F.col("src").alias("at"), "dst").distinct())
    writes = checkpointed(definitions.select("function", "node", "variable").distinct())
    front = writes.select("function", F.col("node").alias("at"), "variable", F.col("node").alias("definition"))
    key = ["function", "node", "variable", "definition"]
    seen: list[DataFrame] = []
    while True:
        new = front.join(edges, ["function", "at"]).select("function", F.col("dst").alias("node"), "variable", "definition").distinct()
        new = checkpointed(new.join(_all(seen), key, "left_anti") if seen else new)
        if not _any(new):
            return _all([*seen, new])
        seen = _grown(seen, new)
        front = new.join(writes, ["function", "node", "variable"], "left_anti").withColumnRenamed("node", "at")


def definition_uses(reaching: DataFrame, uses: DataFrame) -> DataFrame:
    """(function, variable, definition, node): the definitions that a use (function, node, variable) may see."""
    return reaching.join(uses.select("function", "node", "variable").distinct(), ["function", "node", "variable"]).select("function", "variable", "definition", "node")


def carried_states(links: DataFrame, sources: DataFrame, max_steps: int = MAX_FLOW_STEPS) -> DataFrame:
    """(function, node, source, sanitized, steps): what comes from each source to each node. links (function, src, dst, sanitizes) are
    flows of values, sanitizes a number whose bits are rules that the step makes safe; sources (function, node). sanitized holds the
    rules that are safe on the way, steps the fewest steps of such a way: ways are told apart by what they make safe, as a sink is
    safe only if all ways to it are. Ways longer than max_steps are cut, and their end is null in sanitized (UNKNOWN)."""
    links = checkpointed(links.groupBy("function", F.col("src").alias("at"), "dst", "sanitizes").agg(F.lit(1).alias("one")).drop("one"))
    front = sources.select("function", F.col("node").alias("at"), F.col("node").alias("source"), F.lit(0).cast("long").alias("sanitized")).distinct()
    seen, ends = [checkpointed(front.withColumn("steps", F.lit(0)))], None
    for step in range(1, max_steps + 2):
        came = front.join(links, ["function", "at"]).select("function", F.col("dst").alias("at"), "source", F.col("sanitized").bitwiseOR(F.col("sanitizes")).alias("sanitized")).distinct()
        new = checkpointed(came.join(_all(seen), ["function", "at", "source", "sanitized"], "left_anti"))
        if not _any(new):
            break
        if step > max_steps:
            ends = new.select("function", "at", "source", F.lit(None).cast("long").alias("sanitized"), F.lit(step).alias("steps")).distinct()
            break
        seen = _grown(seen, new.withColumn("steps", F.lit(step)))
        front = new
    out = _all(seen if ends is None else [*seen, ends])
    return out.select("function", F.col("at").alias("node"), "source", "sanitized", "steps")


def sink_states(carried: DataFrame, sinks: DataFrame) -> DataFrame:
    """(function, node, rule, source, state, ways, steps) of sinks (function, node, rule number): UNKNOWN if a way to it was cut,
    SANITIZED if all ways make the rule safe, else TAINTED."""
    safe = F.expr("shiftright(sanitized, CAST(rule AS INT)) & 1 = 1")
    rows = carried.join(sinks, ["function", "node"]).groupBy("function", "node", "rule", "source").agg(
        F.bool_or(F.col("sanitized").isNull()).alias("cut"), F.bool_and(F.coalesce(safe, F.lit(True))).alias("safe"), F.count(F.lit(1)).alias("ways"), F.min("steps").alias("steps")
    )
    state = F.when(F.col("cut"), "UNKNOWN").when(F.col("safe"), "SANITIZED").otherwise("TAINTED")
    return rows.select("function", "node", "rule", "source", state.alias("state"), "ways", "steps")


# -- dominators ----------------------------------------------------------------------------------------------------


def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(function, node, dominator, depth): the nodes that are on all ways from the entry of the function to node, itself included;
    depth is the dominator's place among them, 0 for the entry. Nodes that no entry reaches are not there. edges (function,
    src, dst), entries (function, node), one a function.

    A node dominates another if no way reaches that one without it. The nodes of a function are numbered, and a node holds the
    set of those without which it is still reached, 64 to a long; number 0 is none, so bit 0 tells that it is reached at
    all. Sets only grow along the edges, a node taking itself out, so a round passes on what is new (semi-naive) and
    is one join and one aggregation by bit_or. What is missing in the end are the dominators, and their number is the depth. The
    rounds follow the depth of the graph."""
    first = checkpointed(entries.select("function", "node").distinct())
    edges = checkpointed(edges.select("function", F.col("src").alias("at"), F.col("dst").alias("node")).distinct().join(first, ["function", "node"], "left_anti"))
    nodes = with_rank(first.union(edges.select("function", "node")).distinct(), [F.col("node")], "n", by=["function"])
    nodes = checkpointed(nodes.select("function", "node", F.floor(F.col("n") / 64).alias("word"), F.expr("shiftleft(1L, CAST(n % 64 AS INT))").alias("own")))
    words = checkpointed(nodes.groupBy("function", "word").agg(F.bit_or("own").alias("all")))
    own = nodes.select("function", "node", F.col("word").alias("own_word"), "own")
    without = lambda bits: F.when(F.col("word") == F.col("own_word"), bits.bitwiseAND(F.bitwise_not("own"))).otherwise(bits)
    steps = checkpointed(edges.join(own, ["function", "node"]))
    bits, none = F.lit(-1).cast("long"), F.lit(0).cast("long")
    state = checkpointed(first.join(own, ["function", "node"]).join(words, "function").select("function", "node", "word", without(bits).alias("seen"), without(bits).alias("fresh")))
    front = state
    while True:
        came = front.select("function", F.col("node").alias("at"), "word", "fresh").join(steps, ["function", "at"]).select("function", "node", "word", none.alias("seen"), without(F.col("fresh")).alias("came"))
        both = state.select("function", "node", "word", "seen", none.alias("came")).union(came).groupBy("function", "node", "word").agg(F.bit_or("seen").alias("seen"), F.bit_or("came").alias("came"))
        state = checkpointed(both.select("function", "node", "word", F.expr("seen | came").alias("seen"), F.expr("came & ~seen").alias("fresh")))
        front = state.filter("fresh <> 0")
        if not _any(front):
            break
    reached = state.filter("word = 0").select("function", "node").join(words, "function")
    missing = reached.join(state.select("function", "node", "word", "seen"), ["function", "node", "word"], "left")
    missing = checkpointed(missing.select("function", "node", "word", F.expr("all & ~coalesce(seen, 0L)").alias("missing")))
    depth = missing.groupBy("function", "node").agg((F.sum(F.bit_count("missing")) - 1).alias("depth"))
    names = nodes.join(depth, ["function", "node"]).groupBy("function", "word").agg(F.collect_list(F.struct("own", F.col("node").alias("dominator"), "depth")).alias("names"))  # 64 at most
    theirs = F.explode(F.filter("names", lambda x: F.col("missing").bitwiseAND(x["own"]) != 0)).alias("_")
    return missing.filter("missing <> 0").join(names, ["function", "word"]).select("function", "node", theirs).select("function", "node", "_.dominator", "_.depth")


def immediate_dominators(dominators: DataFrame) -> DataFrame:
    """(function, node, idom, depth): the deepest dominator of a node but itself, and how deep the node is; the entry has none."""
    other = F.when(F.col("dominator") != F.col("node"), F.struct("depth", "dominator"))
    return dominators.groupBy("function", "node").agg(F.max(other).alias("_"), F.max("depth").alias("depth")).select("function", "node", F.col("_.dominator").alias("idom"), "depth")


# -- guards ---------------------------------------------------------------------------------------------------------


def proven_sinks(edges: DataFrame, entries: DataFrame, definitions: DataFrame, guards: DataFrame, sinks: DataFrame) -> DataFrame:
    """(function, node, variable, kind, rule_id, verdict, guards) of sinks (function, node, variable, kind): whether guards of the kind
    prove the value that the sink sees. guards (function, src, dst, variable, kind): going from src to dst, the branch that
    holds, proves the value of variable. kind is one of PROOFS, which has the rule that a proof answers.

    Each way from the entry must pass a guard of that kind after the last time the variable is written: PROVEN. If each
    way passes one but some value is written after it: MODIFIED. If some way passes none: UNGUARDED. A sink that no way
    reaches is UNREACHABLE. guards counts those whose value arrives.

    What arrives at a node is a set of bits for each variable and kind that some sink of the function asks for, 64 to a long:
    that the node is reached, that some way has passed no guard, that some value is not proven, and one for each guard of the
    function whose value arrives. Going on, a write leaves an unproven value only, a guard its own. Sets only grow, so a round
    passes on what is new (semi-naive) and is one join and one aggregation by bit_or; it is kept as compressed files,
    and those of the round before go. The rounds follow the depth of the graph."""
    unproven, bare, reached = 1, 2, 4  # guards are numbered from 3
    edge = ["function", "src", "dst"]
    key = ["function", "node", "track", "word"]
    asked = stored(sinks.select("function", "node", "variable", "kind").distinct())
    # a variable is followed for each kind that some sink asks for
    tracks = stored(with_rank(asked.select("function", "variable", "kind").distinct(), [F.col("variable"), F.col("kind")], "track", by=["function"]))
    # each input is stored by itself, as the shuffle files of a statement go at its end
    gates = stored(guards.select(*edge, "variable", "kind").distinct().join(tracks, ["function", "variable", "kind"]).select(*edge, "track"))
    gates = with_rank(gates, [F.col("src"), F.col("dst")], "n", by=["function", "track"]).withColumn("n", F.col("n") + 2)
    gates = gates.groupBy(*edge).agg(F.collect_list(F.struct("track", "n")).alias("gates"))
    writes = definitions.select("function", F.col("node").alias("src"), "variable").distinct().join(tracks, ["function", "variable"])
    writes = stored(writes.groupBy("function", "src").agg(F.collect_list("track").alias("writes")))
    # functions without a sink are not walked
    steps = stored(edges.select(*edge).distinct().join(tracks.select("function").distinct(), "function", "left_semi"))
    steps = stored(steps.join(gates, edge, "left").join(writes, ["function", "src"], "left"))
    none, bit = F.lit(0).cast("long"), lambda x: F.lit(x).cast("long")
    start = entries.select("function", "node").distinct().join(tracks.select("function", "track"), "function")
    state = stored(start.select("function", "node", "track", none.alias("word"), bit(unproven | bare | reached).alias("seen"), bit(unproven | bare | reached).alias("fresh")))
    sent = F.expr(f"""CASE
        WHEN size(gate) > 0 THEN IF(word = 0 AND fresh & {reached} <> 0, array(struct(0L AS word, {reached}L AS came), struct(gate[0].n DIV 64 AS word, shiftleft(1L, CAST(gate[0].n % 64 AS INT)) AS came)), array())
        WHEN coalesce(array_contains(writes, track), false) THEN IF(word = 0, array(struct(0L AS word, fresh & {bare | reached} | IF(fresh & {reached} <> 0, {unproven}L, 0L) AS came)), array())
        ELSE array(struct(word, fresh AS came)) END""")
    while True:
        front = state.filter("fresh <> 0").select("function", F.col("node").alias("src"), "track", "word", "fresh")
        if not _any(front):
            break
        came = front.join(steps, ["function", "src"]).withColumn("gate", F.expr("filter(coalesce(gates, array()), x -> x.track = track)"))
        came = came.select("function", F.col("dst").alias("node"), "track", F.inline(sent)).select(*key, none.alias("seen"), "came")
        both = state.select(*key, "seen", none.alias("came")).union(came).groupBy(*key).agg(F.bit_or("seen").alias("seen"), F.bit_or("came").alias("came"))
        last, state = state, stored(both.select(*key, F.expr("seen | came").alias("seen"), F.expr("came & ~seen").alias("fresh")))
        dropped(last)
    whole = state.groupBy("function", "node", "track").agg(
        F.bit_or(F.when(F.col("word") == 0, F.col("seen"))).alias("flags"),
        F.sum(F.bit_count(F.expr(f"IF(word = 0, seen & ~{unproven | bare | reached}L, seen)"))).alias("guards"),
    )
    seen = asked.join(tracks, ["function", "variable", "kind"], "left").join(whole, ["function", "node", "track"], "left")
    flag = lambda x: F.col("flags").bitwiseAND(bit(x)) != 0
    verdict = F.when(F.col("flags").isNull(), "UNREACHABLE").when(~flag(unproven), "PROVEN").when(~flag(bare), "MODIFIED").otherwise("UNGUARDED")
    rule = F.element_at(F.create_map(*[F.lit(x) for kv in PROOFS.items() for x in kv]), F.col("kind"))
    return seen.select("function", F.col("node").cast("string").alias("node"), "variable", "kind", rule.alias("rule_id"), verdict.alias("verdict"), F.coalesce("guards", none).alias("guards"))


# -- calls ----------------------------------------------------------------------------------------------------------


class Program:
    """The facts of a program: values are nodes of functions.

    flows (function, src, dst): a value goes on within its function; params (function, position, node); returns (function, node);
    args (function, site, callee, position, node): node is an argument of the call at site; results (function, site, callee,
    node): node takes what the call gives; sources (function, node); sinks (function, node, rule)."""

    def __init__(self, flows: DataFrame, params: DataFrame, returns: DataFrame, args: DataFrame, results: DataFrame, sources: DataFrame, sinks: DataFrame):
        keep = lambda df, *c: checkpointed(df.select(*c).distinct())
        self.flows, self.params = keep(flows, "function", "src", "dst"), keep(params, "function", "position", "node")
        self.returns, self.args = keep(returns, "function", "node"), keep(args, "function", "site", "callee", "position", "node")
        self.results, self.sources = keep(results, "function", "site", "callee", "node"), keep(sources, "function", "node")
        self.sinks = keep(sinks, "function", "node", "rule")


def _improved(found: DataFrame, known: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of found that are new or less deep than known, one a key."""
    found = found.groupBy(*key).agg(F.min("depth").alias("depth"))
    if known:
        old = _all(known).groupBy(*key).agg(F.min("depth").alias("_old"))
        found = found.join(old, key, "left").filter(F.col("_old").isNull() | (F.col("depth") < F.col("_old"))).drop("_old")
    return checkpointed(found)


_ORIGIN = ["home", "kind", "origin"]


def value_reach(program: Program, max_depth: int = MAX_CALL_DEPTH) -> DataFrame:
    """(function, home, kind, origin, node, depth): the nodes of function that the value of an origin comes to: a parameter (kind
    'P', origin is its position) of the function itself, or a source (kind 'S', origin is its node) of the function home. depth is
    the least number of calls one within the other that it takes; what takes max_depth + 1 is listed too, as it tells that
    the limit was met, and nothing beyond.

    Calls match their returns: a value that enters a callee comes back only at the call it came from, as what callees do is
    told by their summaries (parameter to return), each worked out once, however many calls there are. A source's value also
    returns to all callers. New summaries become steps of the callers in the next round."""
    deepest = max_depth + 1
    seeds = program.params.select("function", F.col("function").alias("home"), F.lit("P").alias("kind"), F.col("position").cast("string").alias("origin"), "node")
    seeds = seeds.union(program.sources.select("function", "function", F.lit("S"), F.col("node").cast("string"), "node"))
    front = checkpointed(seeds.withColumn("depth", F.lit(0)))
    inner = program.args.select("function", "site", "callee", "position", F.col("node").alias("src")).join(
        program.results.select("function", "site", "callee", F.col("node").alias("dst")), ["function", "site", "callee"]
    )
    inner = checkpointed(inner.select("function", "src", "dst", "callee", F.col("position").cast("string").alias("origin")).distinct())
    known = [front]
    steps = [checkpointed(program.flows.withColumn("least", F.lit(0)))]
    returned: list[DataFrame] = []
    key, by = ["function", *_ORIGIN, "node"], ["function", "src"]
    new_steps = None
    while True:
        go = lambda values, over: values.withColumnRenamed("node", "src").join(over, by).select("function", *_ORIGIN, F.col("dst").alias("node"), F.greatest("depth", "least").alias("depth"))
        found = go(front, _all(steps))
        if new_steps is not None:
            found = found.union(go(_all(known), new_steps))
        given = _improved(front.join(program.returns, ["function", "node"]).select("function", *_ORIGIN, "depth"), returned, ["function", *_ORIGIN])
        returned = _grown(returned, given)
        # sources go back to every caller; parameters make a step of every call
        up = given.filter((F.col("kind") == "S") & (F.col("depth") < deepest)).withColumnRenamed("function", "callee")
        back = up.join(program.results, "callee").select("function", *_ORIGIN, "node", (F.col("depth") + 1).alias("depth"))
        front = _improved(found.union(back), known, key)
        down = given.filter((F.col("kind") == "P") & (F.col("depth") < deepest)).select(F.col("function").alias("callee"), "origin", (F.col("depth") + 1).alias("least"))
        new_steps = checkpointed(inner.join(down, ["callee", "origin"]).groupBy("function", "src", "dst").agg(F.min("least").alias("least")))
        if not _any(front) and not _any(new_steps):
            break
        known, steps = _grown(known, front), _grown(steps, new_steps)
    return _all(known).groupBy(*key).agg(F.min("depth").alias("depth"))


def summaries(program: Program, reach: DataFrame, max_depth: int = MAX_CALL_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(returns, effects) of value_reach(). returns (function, home, kind, origin, depth): what a function gives back of its parameters
    and of sources. effects (function, home, kind, origin, sink_function, sink, rule, depth): the sinks that a parameter, or a
    source from the function where it is last, comes to, in the function itself or in what it calls."""
    returns = reach.join(program.returns, ["function", "node"]).groupBy("function", *_ORIGIN).agg(F.min("depth").alias("depth"))
    reach = checkpointed(reach)
    own = reach.join(program.sinks, ["function", "node"]).select("function", *_ORIGIN, F.col("function").alias("sink_function"), F.col("node").alias("sink"), "rule", "depth")
    handed = reach.join(program.args.select("function", "node", "callee", "position"), ["function", "node"])
    handed = handed.groupBy("function", *_ORIGIN, "callee", F.col("position").cast("string").alias("position")).agg(F.min("depth").alias("before"))
    handed = checkpointed(handed)
    key = ["function", *_ORIGIN, "sink_function", "sink", "rule"]
    known: list[DataFrame] = []
    front = _improved(own, known, key)
    while _any(front):
        known = _grown(known, front)
        below = front.filter((F.col("kind") == "P") & (F.col("depth") <= max_depth)).select(F.col("function").alias("callee"), F.col("origin").alias("position"), "sink_function", "sink", "rule", (F.col("depth") + 1).alias("below"))
        found = handed.join(below, ["callee", "position"]).select("function", *_ORIGIN, "sink_function", "sink", "rule", F.greatest("before", "below").alias("depth"))
        front = _improved(found, known, key)
    effects = _all([*known, front]).groupBy(*key).agg(F.min("depth").alias("depth"))
    return returns, effects


def findings(effects: DataFrame, max_depth: int = MAX_CALL_DEPTH) -> DataFrame:
    """(home, origin, sink_function, sink, rule, depth, state): each source with each sink its value comes to. What is only found
    beyond max_depth is UNKNOWN for CALL_DEPTH_LIMIT, the rest TAINTED."""
    out = effects.filter("kind = 'S'").groupBy("home", "origin", "sink_function", "sink", "rule").agg(F.min("depth").alias("depth"))
    return out.withColumn("state", F.when(F.col("depth") > max_depth, "UNKNOWN").otherwise("TAINTED"))
