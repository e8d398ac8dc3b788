"""Folds, ranks, chains without a bound, specifications in YAML, guards, mutations and call limits on small tables made here."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import assembly, fusion, graph, interprocedural, predictions, ranks, resolution, security
from plumbline.sources import extract, intake
from plumbline.sources.plain_yaml import SpecificationError, read

SPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- chains -------------------------------------------------------------------------------------------------------


def test_a_chain_of_200_containers(spark):
    chain = [(f"n{i}", "CLASS" if i == 0 else "BLOCK", f"n{i - 1}" if i else None) for i in range(200)]
    loop = [("a", "BLOCK", "b"), ("b", "BLOCK", "a")]
    nodes = spark.createDataFrame(chain + loop, "node string, kind string, parent string")
    owner = {r["node"]: r["owner"] for r in graph.owners_of(nodes, ("CLASS",)).collect()}
    assert owner == {**{f"n{i}": "n0" for i in range(200)}, "a": None, "b": None}
    up = graph.ancestors(nodes.select(F.col("node").alias("child"), "parent"))
    depth = {(r["node"], r["ancestor"]): r["depth"] for r in up.collect()}
    assert len(depth) == 200 * 199 // 2 + 2 and depth["n199", "n0"] == 199 and depth["a", "b"] == 1
    found = resolution.at_granularity(spark.createDataFrame([(1, "n199")], "id int, node string"), nodes, "CLASS")
    assert found.first()["target"] == "n0"


def test_ancestors_of_a_graph_equal_brute_force(spark):
    r = random.Random(4)
    pairs = {(r.randrange(30), r.randrange(30)) for _ in range(45)}
    got = {(x["node"], x["ancestor"]): x["depth"] for x in graph.ancestors(spark.createDataFrame(list(pairs), "child int, parent int")).collect()}
    want = {}
    for start in range(30):
        front, seen, k = {start}, {start}, 0
        while front:
            k += 1
            front = {b for a, b in pairs if a in front} - seen
            seen |= front
            want |= {(start, b): k for b in front}
    assert got == want


def test_shortest_path_beyond_any_bound(spark):
    line = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(0, 50), (50, 2), (7, 3)], "src long, dst long")
    assert graph.shortest_path(line, 0, 40) == [0, 1, *range(2, 41)]  # "1" comes before "50"
    assert graph.shortest_path(line, 40, 0) is None and graph.shortest_path(line, 5, 5) == [5]


def test_long_argument_lists():
    many = ", ".join(f"f{i}(a, b)" for i in range(3_000))
    facts = extract.facts("a.ts", f"function g(x) {{ return 1; }}\ncall({many});\nnone( );\none([1, 2, 3]);")
    count = {f[3]: f[7] for f in facts if f[1] == "REFERENCE"}
    assert count["call"] == 3_000 and count["none"] == 0 and count["one"] == 1


# -- ranks and folds ------------------------------------------------------------------------------------------------


def test_ranks_and_quantiles(spark):
    r = random.Random(1)
    data = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(50)]), i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(7)
    got = {x["i"]: x["r"] for x in ranks.with_rank(df, [F.col("v"), F.col("i")], "r").collect()}
    order = sorted(data, key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
    assert got == {x[2]: k + 1 for k, x in enumerate(order)}
    for x in ranks.quantiles(df, "v", ["g"]).collect():
        own = sorted(v for g, v, _ in data if g == x["g"] and v is not None)
        n = len(own)
        assert (x["n"], x["median"], x["p95"]) == (n, (own[(n - 1) // 2] + own[n // 2]) / 2, own[-(-95 * n // 100) - 1])
    assert ranks.quantiles(df.limit(0), "v", ["g"]).count() == 0


def test_greedy_folds_equal_brute_force(spark):
    r = random.Random(2)
    data = [(r.choice(["a", "b", None]), i, r.choice([None, *range(1, 30)])) for i in range(300)]
    df = spark.createDataFrame(data, "g string, i int, n long").repartition(5)
    got = {x["i"]: x["fits"] for x in fusion.greedy(df, "g", ["i"], "n", 200).collect()}
    left, want = {}, {}
    for g, i, n in data:
        room = left.get(g, 200)
        want[i] = n is not None and n <= room
        left[g] = room - (n if want[i] else 0)
    assert got == want


# -- specifications and intake ----------------------------------------------------------------------------------------

SPEC = """# layers
version: "1.0"
project: 'it''s'   # a comment
layers:
- name: web
  paths: [ "**/web/**", src/a ]
  weight: 1_000
- name: db
  paths:
    - "**/db/**"
rules:
  - id: R1
    type: forbidden_dependency
    enabled: yes
    source: {layer: web, module: ~}
    note: >
      two
      lines
    ratio: 1.5
empty:
url: http://x.org/a#b
"""


def test_yaml_specification():
    got = intake.load_specification(SPEC)
    assert got["version"] == "1.0" and got["project"] == "it's" and got["empty"] is None and got["url"] == "http://x.org/a#b"
    assert got["layers"] == [{"name": "web", "paths": ["**/web/**", "src/a"], "weight": 1000}, {"name": "db", "paths": ["**/db/**"]}]
    assert got["rules"] == [{"id": "R1", "type": "forbidden_dependency", "enabled": True, "source": {"layer": "web", "module": None}, "note": "two lines\n", "ratio": 1.5}]


@pytest.mark.parametrize("text", ["a: &x 1", "a: *x", "a: !!int 3", "<<: {a: 1}", "a: 1\na: 2", "a: 0x1F", "a: .inf", "- a", "", "a:\n\t- b", "a: [1, 2", "a: {b: 1, b: 2}", "a: 'x", "a: 1\n  b: 2", "a: " + "[" * 40 + "]" * 40, "a: [" + "1," * 10_001 + "]"])
def test_yaml_that_is_refused(text):
    with pytest.raises(SpecificationError):
        read(text)


def test_nested_ignore_files(spark):
    scopes = {"": ["*.log", "out/"], "a": ["!keep.log", "x"], "a/b": ["keep.log"]}
    want = {"t.log": 1, "a/t.log": 1, "a/keep.log": 0, "a/b/keep.log": 1, "keep.log": 1, "a/x": 1, "b/x": 0, "a/c/x/y": 1, "out/z": 1, "out": 0}
    df = spark.createDataFrame([(p,) for p in want], "path string")
    got = {r["path"]: int(r["why"] == "GITIGNORE") for r in df.select("path", F.coalesce(intake.excluded_by(F.col("path"), (), scopes), F.lit("")).alias("why")).collect()}
    assert got == want


def test_binary_by_content(spark):
    df = spark.createDataFrame([("a.ts", b"let a;"), ("b.ts", b"a\0b"), ("c.ts", b"x" * 9000 + b"\0"), ("d.ts", None), ("Dockerfile", b"FROM x"), ("e.min.js", b""), ("LICENSE", b"")], "path string, content binary")
    kind = {r["path"]: r["kind"] for r in intake.classified(df, content="content").collect()}
    assert kind == {"a.ts": "SOURCE", "b.ts": "BINARY", "c.ts": "SOURCE", "d.ts": "SOURCE", "Dockerfile": "MANIFEST", "e.min.js": "GENERATED", "LICENSE": "DOCUMENTATION"}


def test_secrets_that_are_excused(spark):
    good = "Ab3$xYz9!qWe7#rTy5%uIo2&pLk8"
    cases = [("apiKey", good, True), ("cacheKey", good, False), ("apiKey", "your_" + good, False), ("apiKey", "${" + good, False), ("pass_word", good, False), ("sessionId", good, True), ("apiKey", "Ab3_xYz9_qWe7_rTy5_uIo2_pLk8", True), ("apiKey", "ab3_xyz9_qwe7_rty5_uio2_plk8", False), ("token", "0123-4567-89ab-cdef-0123-4567-89AB", False), ("x", "ghp_" + "a1" * 15, True), ("x", "see ghp_" + "a1" * 15, False), ("x", "-----BEGIN RSA PRIVATE KEY-----\nabc", True)]
    df = spark.createDataFrame(cases, "name string, value string, want boolean")
    for r in df.select("name", "value", "want", security.is_secret(F.col("name"), F.col("value")).alias("got")).collect():
        assert r["want"] == r["got"], (r["name"], r["value"])


# -- guards, calls, mutations ---------------------------------------------------------------------------------------


def test_channels_and_bindings():
    model = {"project": "p", "fingerprint": "f", "specification": "s"}
    graph_ = {**model, "projection": "COMPONENT", "configuration": 1, "projection_fingerprint": 2}
    discovery = {"project": "p", "fingerprint": "f", "graph_configuration": 1, "graph_projection_fingerprint": 2}
    assert assembly.channel_problems(model, static=model, graph=graph_, discovery=discovery, ai=None) == []
    assert assembly.channel_problems(model, static={**model, "specification": None}, graph={**graph_, "projection": "FILE"}) == ["static is of another specification", "graph is no component projection"]
    assert assembly.channel_problems(model, discovery=discovery) == ["discovery is of another graph"]
    assert assembly.channel_problems(model, ai={"project": "p", "fingerprint": "x"}) == ["ai is of another model"]
    plain = {"project": "p", "fingerprint": "f", "configuration": 1}
    assert assembly.binding_problems(model, plain, 1) == [] and len(assembly.binding_problems(model, plain, 2)) == 1
    assert len(assembly.binding_problems(model, {**plain, "findings": ["x"]}, 1)) == len(assembly.binding_problems(model, {**plain, "specification": "s"}, 1)) == 1


def test_call_limits(spark):
    wide = [("hub", f"l{i}") for i in range(300)] + [("mid", f"l{i}") for i in range(200)] + [("two", "mid"), ("two", "mid"), ("over", "hub")]
    deep = [(f"d{i}", f"d{i + 1}") for i in range(6)]
    loop = [("x", "y"), ("y", "x"), ("z", "z"), ("q", "nowhere")]
    names = {a for a, _ in wide + deep + loop} | {f"l{i}" for i in range(300)} | {"d6"}
    states = [(n, "TAINTED" if n == "l7" else "SANITIZED" if n == "l8" else "UNTAINTED") for n in names]
    got = {r["root"]: r for r in interprocedural.call_summaries(spark.createDataFrame(wide + deep + loop, "caller string, callee string"), spark.createDataFrame(states, "function string, state string")).collect()}
    assert len(got) == len(names)
    assert got["hub"]["expansion_limit"] and got["over"]["expansion_limit"] and got["two"]["expansion_limit"] and got["hub"]["expansions"] is None
    assert (got["mid"]["expansions"], got["mid"]["state"]) == (201, "TAINTED") and got["l8"]["state"] == "SANITIZED"
    assert got["d0"]["depth_limit"] and got["d2"]["depth_limit"] and not got["d3"]["depth_limit"] and got["d3"]["expansions"] == 4
    assert got["x"]["recursion"] and got["z"]["recursion"] and got["z"]["state"] == "UNKNOWN" and got["q"]["state"] == "UNKNOWN" and not got["q"]["recursion"]


def test_mutation_is_found_again(spark, tmp_path):
    java = "package shop.web;\npublic class Page {\n    // BENCHMARK_DEPENDENCIES\n}\n"
    files = spark.createDataFrame([("src/shop/web/Page.java", java), ("src/shop/db/Repo.java", "package shop.db;\npublic class Repo { }\n"), ("src/a.ts", "// BENCHMARK_DEPENDENCIES\r\n"), ("src/b/c.ts", "x")], "path string, text string")
    mutations = [(1, "src/shop/web/Page.java", "src/shop/db/Repo.java", "JAVA", "shop.db.Repo"), (2, "src/a.ts", "src/b/c.ts", "TYPESCRIPT", "C"), (3, "src/b/c.ts", "src/a.ts", "TYPESCRIPT", "A"), (4, "src/shop/web/Page.java", "src/shop/db/Repo.java", "JAVA", "shop.db.1x"), (5, "src/shop/web/Page.java", "src/shop/db/Repo.java", "PYTHON", "x")]
    m = spark.createDataFrame(mutations, "mutation int, source_path string, target_path string, language string, target_name string")
    got = {r["mutation"]: r for r in predictions.mutated(files, m).collect()}
    assert got[1]["text"] == java.replace("// BENCHMARK_DEPENDENCIES", "shop.db.Repo benchmarkDependency;")
    assert [got[i]["problem"] for i in (1, 2, 3, 4, 5)] == [None, "MARKER", "MARKER", "NAME", "LANGUAGE"]
    refs = [("src/a/x.ts", "src/a/y.ts", "./y"), ("src/a/x.ts", "src/b/c/y.ts", "../b/c/y"), ("x.ts", "lib/y.ts", "./lib/y"), ("a/b/x.ts", "y.ts", "../../y")]
    df = spark.createDataFrame(refs, "a string, b string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", predictions.module_reference(F.col("a"), F.col("b")).alias("got")).collect())
    cycle = spark.createDataFrame([(1, "a", "b", ["a", "b", "c"]), (2, "a", "b", ["a", "b", "c"]), (3, "a", "b", ["a", "b"])], "mutation int, source_path string, target_path string, paths array<string>")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (2, "a", "b"), (2, "b", "c"), (3, "a", "b"), (3, "b", "a")], "mutation int, src_path string, dst_path string")
    assert rows(predictions.verified(cycle, edges, "ARCH003")) == [(1, True), (2, False), (3, False)]


def test_predictions_refuse_what_is_not_theirs(spark):
    bad = spark.createDataFrame([("f", "ARCH003", "a", "b")], "finding string, rule_id string, source string, target string")
    with pytest.raises(ValueError, match="cycle"):
        predictions.static_predictions(bad, SPACE, "r")
    said = spark.createDataFrame([("c", "ARCH201", ["a"], "SUPPORTED")], "candidate string, rule_id string, subjects array<string>, decision string")
    asked = spark.createDataFrame([("ARCH201", "b")], "rule_id string, node string")
    with pytest.raises(ValueError, match="asked"):
        predictions.semantic_predictions(said, asked, SPACE, "r")
    cycles = spark.createDataFrame([("f", "ARCH003", ["b", "a"]), ("g", "ARCH003", ["a", "b"])], "finding string, rule_id string, members array<string>")
    assert predictions.cycle_predictions(cycles, SPACE, "r").select("prediction_id").distinct().count() == 1
