"""Queries that read whole tables, against brute force; and the SQL of parts, against the same part."""

import os
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from plumbline.plans.adapters import PARTS, WHOLE, relation

DATA = "/root/testdata/sf0.001"
entry.queries()  # fills PARTS
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    return con


def same(df, con, sql):
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    assert got == sorted(con.execute(f"select {columns} from ({sql})").fetchall(), key=str)
    return got


@pytest.mark.parametrize("name", sorted(PARTS))
def test_part_equals_sql(spark, con, name):
    f, sql = PARTS[name]
    same(f(spark, DATA), con, sql)


def run(spark, name):
    return [tuple(r) for r in entry.queries()[name](spark, DATA).collect()]


@pytest.fixture(scope="module")
def follows(con):
    """(users, all pairs of different users that follow each other within an event type), in plain Python."""
    users, by_type = set(), defaultdict(list)
    for u, t, ts, e in con.execute("select user_id, event_type, ts, event_id from events").fetchall():
        users.add(u)
        by_type[t].append((ts, e, u))
    pairs = {(a[2], b[2]) for x in by_type.values() for a, b in zip(sorted(x), sorted(x)[1:], strict=False) if a[2] != b[2]}
    return users, pairs


def levels(users, pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    for s in users:
        seen, front, d = {s: 0}, {s}, 0
        while front:
            d += 1
            front = {b for a in front for b in out[a]} - set(seen)
            seen |= dict.fromkeys(front, d)
        yield s, seen


def test_components_of_all_successors(spark, follows):
    users, pairs = follows
    reach = dict(levels(users, pairs))
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in users}
    assert dict(run(spark, "strong_components")) == want
    inner = Counter(want[a] for a, b in pairs if want[a] == want[b])
    size = Counter(want.values())
    assert {x[0]: x[1:] for x in run(spark, "component_summary")} == {c: (n, inner[c], n > 1) for c, n in size.items()}
    cyclic = {c for c, n in size.items() if n > 1}
    walks = defaultdict(list)
    for c, seq, v, cut in run(spark, "cycle_proofs"):
        assert not cut
        walks[c].append((seq, v))
    assert set(walks) == cyclic
    for c, walk in walks.items():
        path = [v for _, v in sorted(walk)]
        assert path[0] == path[-1] == c and all(p in pairs for p in zip(path, path[1:], strict=False))
    assert {(x[1], x[2]) for x in run(spark, "circular_findings")} == {(c, size[c]) for c in cyclic}


def test_neighbourhoods_of_all_successors(spark, follows):
    reach = dict(levels(*follows))
    assert dict(run(spark, "k_hop")) == {v: d for v, d in reach[1].items() if d <= 4}
    got = {(s, v): d for s, v, d in run(spark, "path_lengths")}
    assert {s for s, _ in got} == follows[0]
    for s in follows[0]:
        assert {v: d for (t, v), d in got.items() if t == s} == {v: d for v, d in reach[s].items() if d <= 6}


def ranks(users, pairs, rounds):
    n, deg = len(users), Counter(a for a, _ in pairs)
    r = dict.fromkeys(users, 1 / n)
    for _ in range(rounds):
        lost = sum(x for v, x in r.items() if not deg[v])
        new = dict.fromkeys(users, 0.15 / n + 0.85 * lost / n)
        for a, b in pairs:
            new[b] += 0.85 * r[a] / deg[a]
        r = new
    return r


def test_ranks_of_all_successors(spark, follows):
    assert dict(run(spark, "pagerank_six_rounds")) == pytest.approx(ranks(*follows, 6), abs=2e-9)


def test_converged_ranks(spark, follows):
    assert dict(run(spark, "pagerank")) == pytest.approx(ranks(*follows, 300), abs=1e-8)


def test_selection_and_difference_of_all_successors(spark, con, follows):
    pairs = follows[1]
    best = {}
    for a, b in pairs:
        best[a] = min(best.get(a, (9, 9)), (b % 4, b % 9))
    want = sorted((*k, a) for a, k in best.items())[:20]
    got = [(r["priority"], r["distance"], r["node"]) for r in entry.queries()["context_selection"](spark, DATA).collect()]
    assert sorted(got) == want
    halves = [{tuple(r) for r in relation(spark, DATA, f"follow_{x}").collect()} for x in ("earlier", "later")]
    assert halves[0] | halves[1] == pairs
    assert set(run(spark, "edge_difference")) == {(*p, "ADDED") for p in halves[1] - halves[0]} | {(*p, "REMOVED") for p in halves[0] - halves[1]}


def test_component_graph_has_all_pairs(spark, con):
    pairs = set(con.execute("""select distinct a.n_name, b.n_name from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        join supplier on l_suppkey = s_suppkey join nation a on c_nationkey = a.n_nationkey join nation b on s_nationkey = b.n_nationkey""").fetchall())
    layer = dict(con.execute("select n_name, r_name from nation join region on n_regionkey = r_regionkey").fetchall())
    key = dict(con.execute("select n_name, n_nationkey from nation").fetchall())
    ca = {v: sum(b == v != a for a, b in pairs) for v in layer}
    ce = {v: sum(a == v != b for a, b in pairs) for v in layer}
    m = {r["v"]: r for r in entry.queries()["node_metrics_all_pairs"](spark, DATA).collect()}
    assert {v: (r["ca"], r["ce"]) for v, r in m.items()} == {v: (ca[v], ce[v]) for v in layer}
    assert [x[:2] for x in run(spark, "topology_top_k")] == sorted(ca.items(), key=lambda x: (-x[1], x[0]))[:5]
    labels = Counter((layer[a], layer[b]) for a, b in pairs)
    assert {x[:2]: x[2] for x in run(spark, "dependency_matrix")} == labels
    names = sorted(set(layer.values()))
    for name, key_column in (("module_cohesion", "label"), ("layer_groups", "label")):
        got = {r[key_column]: (r["internal"], r["outgoing"], r["incoming"]) for r in entry.queries()[name](spark, DATA).collect()}
        for x in names:
            assert got[x] == (labels[x, x], sum(n for (a, b), n in labels.items() if a == x != b), sum(n for (a, b), n in labels.items() if b == x != a))
    unstable = {(a, b) for a, b in pairs if a != b and ce[b] / (ca[b] + ce[b]) - ce[a] / (ca[a] + ce[a]) >= 0.2 - 1e-13}
    assert {x[1:] for x in run(spark, "graph_candidates") if x[0] == "ARCH104"} == unstable
    upward = {v: ",".join(sorted({layer[b] for a, b in pairs if a == v and layer[a] < layer[b]})) for v in key}
    assert {r["subject"]: r["evidence"] for r in entry.queries()["direction_evidence"](spark, DATA).collect()} == {v: x for v, x in upward.items() if x}
    # Brandes' dependencies by counting shortest paths
    dist, ways = {}, {}
    for s, seen in levels(set(layer), pairs):
        ways[s, s] = 1
        for v, d in sorted(seen.items(), key=lambda x: x[1]):
            dist[s, v] = d
            if d:
                ways[s, v] = sum(ways[s, u] for u, w in pairs if w == v and seen.get(u) == d - 1)
    want = dict.fromkeys(layer, 0.0)
    for s, t in dist:
        for v in layer:
            if v not in (s, t) and s != t and (s, v) in dist and (v, t) in dist and dist[s, v] + dist[v, t] == dist[s, t]:
                want[v] += ways[s, v] * ways[v, t] / ways[s, t]
    assert dict(run(spark, "betweenness")) == pytest.approx({v: x / (24 * 23) for v, x in want.items()}, abs=2e-9)


# the condition that makes the SQL of a part a part
CONDITIONS = {
    "resolve_status": " WHERE page_id % 9 = 0",
    "resolution_ladder": " WHERE o_orderkey % 20 = 1",
    "arity_join": " WHERE o_orderkey % 10 = 3",
    "model_violations": " WHERE o_orderkey % 50 = 7",
    "evidence_alignment": " WHERE c_custkey % 15 = 0",
    "kappa_rater_pairs": " WHERE o_custkey % 10 = 1",
    "grouped_split": " WHERE o_orderkey % 5 = 0",
    "scoped_extras": " WHERE o_orderkey % 6 = 0",
    "role_arbitration": " WHERE c_custkey % 4 = 1",
}


@pytest.mark.parametrize("name", sorted(CONDITIONS))
def test_whole_equals_sql_without_the_condition(spark, con, name):
    sql = PARTS[f"{name}_part"][1]
    assert sql.count(CONDITIONS[name]) == 1
    assert same(entry.queries()[name](spark, DATA), con, sql.replace(CONDITIONS[name], ""))


@pytest.mark.parametrize("name", ["node_metrics", "training_rows", *sorted(WHOLE)])
def test_query_over_all_rows_equals_its_sql(spark, con, name):
    assert same(entry.queries()[name](spark, DATA), con, entry.oracle_sql()[name])


def test_fragments_of_all_files(spark, con):
    files = defaultdict(list)
    for f, p, a, b in con.execute("select l_partkey::varchar, l_linenumber, l_orderkey % 500, (l_orderkey % 500 + l_quantity)::bigint from lineitem").fetchall():
        files[f].append((p, a, b))
    want = []
    for f, x in files.items():
        kept = []
        for p, a, b in sorted(x):
            a = max(1, a - 2)
            b = min(b + 2, a + 119)
            if all(b < y or a > z for _, y, z in kept):
                kept.append((p, a, b))
        want += [(f, *k) for k in kept]
    assert sorted(run(spark, "fragment_merge")) == sorted(want)
