"""Data flow operators against brute force on random program graphs."""

import random
from collections import deque

import pytest

from plumbline.operators import dataflow as D

EDGES = "function long, src long, dst long"


def graphs(seed, functions=12, nodes=9):
    r = random.Random(seed)
    out = {}
    for f in range(functions):
        n = r.randint(1, nodes)
        out[f] = sorted({(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 2 * n))} | {(i, i + 1) for i in range(n - 1) if r.random() < 0.7})
    return out


def table(spark, rows, schema):
    return spark.createDataFrame(sorted(rows), schema)


def edge_rows(spark, program):
    return table(spark, [(f, a, b) for f, own in program.items() for a, b in own], EDGES)


def reached(edges, start, without=()):
    """Nodes that start comes to in one step or more, not going on from nodes of without."""
    seen, todo = set(), deque([start])
    while todo:
        at = todo.popleft()
        for a, b in edges:
            if a == at and b not in seen:
                seen.add(b)
                if b not in without:
                    todo.append(b)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_reaching_definitions(spark, seed):
    r = random.Random(seed)
    program = graphs(seed)
    writes = {(f, r.randrange(9), v) for f in program for v in "xy" for _ in range(3)}
    want = set()
    for f, n, v in writes:
        killers = {m for g, m, w in writes if g == f and w == v}
        want |= {(f, node, v, n) for node in reached(program[f], n, killers)}
    got = D.reaching_definitions(edge_rows(spark, program), table(spark, writes, "function long, node long, variable string"))
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    uses = table(spark, {(f, n, v) for f, n, v, _ in want if n % 2}, "function long, node long, variable string")
    assert {tuple(x) for x in D.definition_uses(got, uses).collect()} == {(f, v, d, n) for f, n, v, d in want if n % 2}


def test_no_rows_at_all(spark):
    edges = spark.createDataFrame([], EDGES)
    nodes = spark.createDataFrame([], "function long, node long")
    assert D.reaching_definitions(edges, spark.createDataFrame([], "function long, node long, variable string")).count() == 0
    assert D.dominators(edges, nodes).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dominators(spark, seed):
    program = graphs(seed)
    entries = table(spark, [(f, 0) for f in program], "function long, node long")
    table_ = D.dominators(edge_rows(spark, program), entries)
    got = {}
    for r in table_.orderBy("function", "node", "depth").collect():
        got.setdefault((r.function, r.node), []).append(r.dominator)
    want = {}
    for f, own in program.items():
        alive = reached(own, 0) | {0}
        for n in alive:
            # a vertex dominates if its removal cuts the way
            want[f, n] = {d for d in alive if d in (0, n) or n not in reached([e for e in own if d not in e], 0)} if n else {0}
    assert {k: set(v) for k, v in got.items()} == want
    assert all(set(got[f, d]) == set(chain[: i + 1]) for (f, _), chain in got.items() for i, d in enumerate(chain))
    idoms = {(r.function, r.node): (r.idom, r.depth) for r in D.immediate_dominators(table_).collect()}
    assert idoms == {k: (c[-2] if len(c) > 1 else None, len(c) - 1) for k, c in got.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_guards_must_dominate_the_unmodified_value(spark, seed):
    r = random.Random(seed)
    program = graphs(seed, functions=40, nodes=6)
    kinds = ("PATH_CONFINEMENT", "SSRF_ALLOWLIST")
    writes = {(f, r.randrange(6), v) for f in program for v in "xy" if r.random() < 0.6}
    guards = {(f, a, b, r.choice("xy"), r.choice(kinds)) for f, own in program.items() for a, b in own if r.random() < 0.5}
    sinks = {(f, r.randrange(6), v, k) for f in program for v in "xy" for k in kinds}
    got = D.proven_sinks(
        edge_rows(spark, program), table(spark, [(f, 0) for f in program], "function long, node long"), table(spark, writes, "function long, node long, variable string"),
        table(spark, guards, EDGES + ", variable string, kind string"), table(spark, sinks, "function long, node long, variable string, kind string"),
    )
    got = {(x.function, int(x.node), x.variable, x.kind): (x.verdict, x.rule_id) for x in got.collect()}
    assert set(got) == sinks
    for f, n, v, k in sinks:
        # ways as states: (node entered, guarded since the last write, a guard at any time)
        start = (0, False, False)
        seen, todo = {start}, deque([start])
        while todo:
            at, fresh, ever = todo.popleft()
            if (f, at, v) in writes:
                fresh = False
            for a, b in program[f]:
                if a == at:
                    gate = (f, a, b, v, k) in guards
                    state = (b, fresh or gate, ever or gate)
                    if state not in seen:
                        seen.add(state)
                        todo.append(state)
        there = [s for s in seen if s[0] == n]
        want = "UNREACHABLE" if not there else "PROVEN" if all(s[1] for s in there) else "MODIFIED" if all(s[2] for s in there) else "UNGUARDED"
        assert got[f, n, v, k] == (want, {"PATH_CONFINEMENT": "SEC004", "SSRF_ALLOWLIST": "SEC006"}[k])
    assert {x for x, _ in got.values()} >= {"UNREACHABLE", "PROVEN", "UNGUARDED"}


def test_a_write_after_the_guard_undoes_it(spark):
    """0 -> 1 is guarded, 1 writes x, 2 and 3 see it; y is not written; code that nothing reaches (9) does not count."""
    edges = table(spark, [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 9, 3)], EDGES)
    one = lambda rows, more: table(spark, rows, f"function long, node long, variable string{more}")
    guards = table(spark, [(1, 0, 1, v, "PATH_CONFINEMENT") for v in "xy"], EDGES + ", variable string, kind string")
    sinks = one([(1, 3, "x", "PATH_CONFINEMENT"), (1, 3, "y", "PATH_CONFINEMENT"), (1, 3, "y", "SSRF_ALLOWLIST"), (1, 9, "y", "PATH_CONFINEMENT")], ", kind string")
    got = D.proven_sinks(edges, table(spark, [(1, 0)], "function long, node long"), one([(1, 1, "x"), (1, 9, "y")], ""), guards, sinks)
    want = {("3", "x", "PATH_CONFINEMENT", "MODIFIED"), ("3", "y", "PATH_CONFINEMENT", "PROVEN"), ("3", "y", "SSRF_ALLOWLIST", "UNGUARDED"), ("9", "y", "PATH_CONFINEMENT", "UNREACHABLE")}
    assert {(r.node, r.variable, r.kind, r.verdict) for r in got.collect()} == want


def test_rounds_of_proven_sinks_leave_few_files(spark, tmp_path, monkeypatch):
    """The tables of the rounds before are gone, however long the way is; 70 guards are more than the bits of one long."""
    from plumbline.operators import graph

    made, gone = [], []
    real, drop = graph.stored, graph.dropped
    monkeypatch.setattr(D, "stored", lambda df: made.append(real(df)) or made[-1])
    monkeypatch.setattr(D, "dropped", lambda df: gone.append(df._stored_at) or drop(df))
    sides = [(1, 0, i) for i in range(1, 71)] + [(1, i, 71) for i in range(1, 71)]
    chain = [(1, i, i + 1) for i in range(71, 75)]
    guards = table(spark, [(1, 0, i, "x", "PATH_CONFINEMENT") for i in range(1, 71)], EDGES + ", variable string, kind string")
    sinks = table(spark, [(1, n, "x", "PATH_CONFINEMENT") for n in (0, 70, 71, 75)], "function long, node long, variable string, kind string")
    writes = table(spark, [(1, 73, "x")], "function long, node long, variable string")
    got = D.proven_sinks(table(spark, sides + chain, EDGES), table(spark, [(1, 0)], "function long, node long"), writes, guards, sinks)
    assert {(r.node, r.verdict, r.guards) for r in got.collect()} == {("0", "UNGUARDED", 0), ("70", "PROVEN", 1), ("71", "PROVEN", 70), ("75", "MODIFIED", 0)}
    kept = {df._stored_at for df in made} - set(gone)
    assert len(gone) >= 5 and len(kept) <= 8


def test_states_carry_what_each_way_makes_safe(spark):
    links = [(1, 0, 1, 0), (1, 1, 2, 4), (1, 0, 2, 2), (1, 2, 3, 0), (1, 3, 2, 1), (2, 0, 1, 4), (2, 1, 2, 0)]
    carried = D.carried_states(table(spark, links, EDGES + ", sanitizes long"), table(spark, [(1, 0), (2, 0)], "function long, node long"))
    got = {(r.function, r.node, r.sanitized): r.steps for r in carried.collect()}
    assert got == {(1, 0, 0): 0, (1, 1, 0): 1, (1, 2, 4): 2, (1, 2, 2): 1, (1, 3, 4): 3, (1, 3, 2): 2, (1, 2, 5): 4, (1, 2, 3): 3, (1, 3, 5): 5, (1, 3, 3): 4, (2, 0, 0): 0, (2, 1, 4): 1, (2, 2, 4): 2}
    sinks = table(spark, [(1, 3, 2), (2, 2, 2)], "function long, node long, rule long")
    assert {(r.function, r.state, r.ways) for r in D.sink_states(carried, sinks).collect()} == {(1, "TAINTED", 4), (2, "SANITIZED", 1)}


def test_long_ways_are_unknown(spark):
    chain = table(spark, [(1, i, i + 1, 0) for i in range(9)], EDGES + ", sanitizes long")
    source = table(spark, [(1, 0)], "function long, node long")
    sinks = table(spark, [(1, 4, 0), (1, 5, 0), (1, 6, 0)], "function long, node long, rule long")
    got = {r.node: r.state for r in D.sink_states(D.carried_states(chain, source, max_steps=4), sinks).collect()}
    assert got == {4: "TAINTED", 5: "UNKNOWN"}


# calls


def random_program(seed, functions=7):
    r = random.Random(seed)
    facts = {k: set() for k in ("flows", "params", "returns", "args", "results", "sources", "sinks")}
    for f in range(functions):
        nodes = [100 * f + i for i in range(7)]
        facts["flows"] |= {(f, *r.sample(nodes, 2)) for _ in range(5)}
        facts["params"] |= {(f, p, nodes[p]) for p in range(2)}
        facts["returns"] |= {(f, n) for n in nodes if r.random() < 0.25}
        facts["sources"] |= {(f, n) for n in nodes if r.random() < 0.12}
        facts["sinks"] |= {(f, n, "SEC002") for n in nodes if r.random() < 0.15}
        for site in range(r.randint(0, 2)):
            callee = r.randrange(functions)
            facts["args"] |= {(f, 10 * f + site, callee, p, r.choice(nodes)) for p in range(2)}
            facts["results"].add((f, 10 * f + site, callee, r.choice(nodes)))
    return facts


SCHEMAS = {
    "flows": EDGES, "params": "function long, position int, node long", "returns": "function long, node long", "args": "function long, site long, callee long, position int, node long",
    "results": "function long, site long, callee long, node long", "sources": "function long, node long", "sinks": "function long, node long, rule string",
}


def explicit_stacks(facts, limit):
    """All ways with an explicit call string: least depth of (home, kind, origin) at each node with an empty string, and at sinks
    with any. Each push is at most `limit` deep; each return without a call to match adds one."""
    seeds = [(f, "P", str(p), n) for f, p, n in facts["params"]] + [(f, "S", str(n), n) for f, n in facts["sources"]]
    at_node, at_sink, returned = {}, {}, {}
    for f, kind, origin, n in seeds:
        best, todo = {}, deque([((f, n, ()), 0)])
        while todo:
            state, depth = todo.popleft()
            if depth > limit or best.get(state, 99) <= depth:
                continue
            best[state] = depth
            g, at, stack = state
            todo.extend(((g, b, stack), depth) for h, a, b in facts["flows"] if (h, a) == (g, at))
            for h, site, callee, p, a in facts["args"]:
                if (h, a) == (g, at):
                    todo.extend(((callee, m, (*stack, (h, site))), max(depth, len(stack) + 1)) for c, q, m in facts["params"] if (c, q) == (callee, p))
            if (g, at) in facts["returns"]:
                for h, site, callee, m in facts["results"]:
                    if callee == g and stack and stack[-1] == (h, site):
                        todo.append(((h, m, stack[:-1]), depth))
                    elif callee == g and not stack and kind == "S":
                        todo.append(((h, m, ()), depth + 1))
        for (g, at, stack), depth in best.items():
            if not stack:
                at_node[g, f, kind, origin, at] = min(depth, at_node.get((g, f, kind, origin, at), 99))
                if (g, at) in facts["returns"]:
                    returned[g, f, kind, origin] = min(depth, returned.get((g, f, kind, origin), 99))
            if (g, at, "SEC002") in facts["sinks"]:
                at_sink[f, kind, origin, g, at] = min(depth, at_sink.get((f, kind, origin, g, at), 99))
    return at_node, returned, at_sink


@pytest.mark.parametrize("seed,limit", [(1, 2), (2, 1), (3, 3), (4, 2)])
def test_calls_match_their_returns(spark, seed, limit):
    facts = random_program(seed)
    program = D.Program(**{k: spark.createDataFrame(sorted(v), SCHEMAS[k]) for k, v in facts.items()})
    reach = D.value_reach(program, limit)
    at_node, returned, at_sink = explicit_stacks(facts, limit + 1)
    assert {(r.function, r.home, r.kind, r.origin, r.node): r.depth for r in reach.collect()} == at_node
    returns, effects = D.summaries(program, reach, limit)
    assert {(r.function, r.home, r.kind, r.origin): r.depth for r in returns.collect()} == returned
    got = {}
    for r in effects.collect():
        key = (r.home, r.kind, r.origin, r.sink_function, r.sink)
        got[key] = min(r.depth, got.get(key, 99))
    assert got == at_sink
    found = {(r.home, r.origin, r.sink_function, r.sink): r.state for r in D.findings(effects, limit).collect()}
    assert found == {(f, o, g, n): "UNKNOWN" if d > limit else "TAINTED" for (f, k, o, g, n), d in at_sink.items() if k == "S"}


def test_a_value_does_not_return_to_another_call(spark):
    """f and g both call id; what f passes comes back to f only."""
    facts = {
        "flows": [(0, 0, 1)], "params": [(0, 0, 0)], "returns": [(0, 1)], "args": [(1, 1, 0, 0, 100), (2, 2, 0, 0, 200)],
        "results": [(1, 1, 0, 101), (2, 2, 0, 201)], "sources": [(1, 100)], "sinks": [(1, 101, "SEC002"), (2, 201, "SEC002")],
    }
    program = D.Program(**{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in facts.items()})
    got = D.findings(D.summaries(program, D.value_reach(program))[1]).collect()
    assert [(r.home, r.sink_function, r.sink, r.depth, r.state) for r in got] == [(1, 1, 101, 1, "TAINTED")]
