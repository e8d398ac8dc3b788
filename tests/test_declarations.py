"""Declarations, members, packs, lineage, strict JSON and manifests against brute force and literal cases."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.functions.strict import object_problem, strict_json
from plumbline.operators import assembly, declarations, lineage
from plumbline.sources import manifests

# declarations


def nested(r, file, start, end, depth, out):
    """Random declarations with distinct starts inside [start, end]."""
    at = start
    while at < end - 1 and len(out) < 400:
        a = r.randint(at, end - 1)
        b = r.randint(a, end - 1)
        out.append((file, len(out), a, b, r.choice("fgh"), r.randint(0, 2)))
        if depth and b - a > 2:
            nested(r, file, a + 1, b, depth - 1, out)
        at = b + 1


@pytest.fixture(scope="module")
def program():
    r = random.Random(5)
    out = []
    for file in range(4):
        nested(r, file, 0, 90, 3, out)
    calls = [(i, r.randrange(5), r.randrange(95), r.choice("fgh"), r.randint(0, 2)) for i in range(300)]
    return out, calls


SCHEMA = "file long, declaration long, start long, end long, name string, arity int"


def around(rows, file, position):
    """Declarations around a position, innermost first."""
    own = [d for d in rows if d[0] == file and d[2] <= position <= d[3]]
    return [d[1] for d in sorted(own, key=lambda d: (d[3] - d[2], -d[2]))]


def test_innermost_declaration(spark, program):
    rows, calls = program
    points = spark.createDataFrame([(c[1], c[0], c[2]) for c in calls], "file long, point long, position long")
    got = {r.point: r.declaration for r in declarations.enclosing(spark.createDataFrame(rows, SCHEMA), points).collect()}
    assert got == {c[0]: next(iter(around(rows, c[1], c[2])), None) for c in calls}


def test_scopes_in_order(spark, program):
    rows, _ = program
    got = {}
    for r in declarations.scopes(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.declaration, {})[r.distance] = r.scope
    for f, d, start, *_ in rows:
        assert got[d] == dict(enumerate([*around(rows, f, start), None]))


def test_lexical_lookup_takes_the_nearest_scope(spark, program):
    rows, calls = program
    df = spark.createDataFrame(calls, "call long, file long, position long, name string, arity int")
    got = {r.call: (r.state, r.candidates, r.targets) for r in declarations.lexical_targets(df, spark.createDataFrame(rows, SCHEMA)).collect()}
    outer = {d: next(iter(around(rows, f, s)[1:]), None) for f, d, s, *_ in rows}
    for c, file, position, name, arity in calls:
        for scope in [*around(rows, file, position), None]:
            found = sorted(d for f, d, _, _, n, a in rows if (f, n, a) == (file, name, arity) and outer[d] == scope)
            if found:
                break
        state = "AMBIGUOUS" if len(found) > 1 else "UNAMBIGUOUS_LOCAL" if found else "UNRESOLVED"
        assert got[c] == (state, len(found), [str(x) for x in found[:4]])
    assert {s for s, *_ in got.values()} == {"AMBIGUOUS", "UNAMBIGUOUS_LOCAL", "UNRESOLVED"}


def test_nearest_base_overrides(spark):
    bases = spark.createDataFrame([("C", "B"), ("B", "A"), ("C", "I"), ("D", "C"), ("X", "Y"), ("Y", "X")], "type string, base string")
    members = spark.createDataFrame([("A", "run", 0, "A.run"), ("B", "run", 0, "B.run"), ("I", "run", 0, "I.run"), ("A", "stop", 1, "A.stop"), ("Y", "go", 0, "Y.go"), ("Z", "alone", 0, "Z.alone")], "type string, name string, arity int, target string")
    calls = [(1, "B", "run", 0), (2, "C", "run", 0), (3, "D", "stop", 1), (4, "D", "stop", 0), (5, "X", "go", 0), (6, "Z", "alone", 0), (7, "W", "run", 0)]
    got = {r.call: (r.state, r.targets) for r in declarations.member_targets(spark.createDataFrame(calls, "call long, type string, name string, arity int"), members, bases).collect()}
    assert got == {1: ("EXACT", ["B.run"]), 2: ("AMBIGUOUS", ["B.run", "I.run"]), 3: ("EXACT", ["A.stop"]), 4: ("UNRESOLVED", []), 5: ("EXACT", ["Y.go"]), 6: ("EXACT", ["Z.alone"]), 7: ("UNRESOLVED", [])}


def test_packs_need_all_preconditions_and_no_invalidator(spark):
    r = random.Random(3)
    asked = {(p, f): r.random() < 0.25 for p in range(8) for f in r.sample(range(12), 4)}
    facts = {f: set(r.sample(range(12), r.randint(0, 9))) for f in range(60)}
    rows = [(f, x) for f, own in facts.items() for x in own for _ in range(r.randint(1, 2))]
    got = {(x.file, x.pack): x.status for x in declarations.packs_that_hold(spark.createDataFrame(rows, "file long, fact long"), spark.createDataFrame([(p, f, b) for (p, f), b in asked.items()], "pack long, fact long, invalidates boolean")).collect()}
    want = {}
    for f, own in facts.items():
        for p in range(8):
            pre, bad = {x for (q, x), b in asked.items() if q == p and not b}, {x for (q, x), b in asked.items() if q == p and b}
            if own & (pre | bad):
                want[f, p] = "INVALIDATED" if own & bad else "HOLDS" if pre <= own else "INCOMPLETE"
    assert got == want and set(want.values()) == {"INVALIDATED", "HOLDS", "INCOMPLETE"}


# lineage


def walk(rows, start):
    own = {r[0]: r for r in rows}
    seen, at = [start], start
    while own[at][1] is not None:
        if own[at][1] not in own:
            return "MISSING", len(seen) - 1, None
        at = own[at][1]
        if at in seen:
            return "CYCLE", None, min(seen[seen.index(at) :])
        seen.append(at)
        if own[at][2:] != own[start][2:]:
            break
    else:
        return None, len(seen) - 1, None
    while own[at][1] in own and own[at][1] not in seen:
        at = own[at][1]
        seen.append(at)
    end = own[at][1]
    return "CROSSING", None if end in own else len(seen) - 1, min(seen[seen.index(end) :]) if end in own else None


@pytest.mark.parametrize("seed", [1, 2])
def test_lineage_against_a_walk(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, 900 + i, *[r.randrange(120)] * 6]), r.choice("aaaaaab"), r.choice(["TRAIN"] * 9 + ["TEST"])) for i in range(120)]
    got = lineage.lineage_problems(spark.createDataFrame(rows, "repository long, base long, family string, split string"))
    got = {x.repository: (x.problem, x.ancestors, x.cycle) for x in got.collect()}
    assert got == {i: walk(rows, i) for i, *_ in rows}


def test_a_lineage_of_a_thousand(spark):
    chain = [(i, i - 1 if i else None, "f", "TRAIN") for i in range(1000)] + [(2000 + i, 2000 + (i + 1) % 700, "f", "TRAIN") for i in range(700)] + [(5000, 5001, None, None), (5001, None, None, None)]
    got = {x.repository: x for x in lineage.lineage_problems(spark.createDataFrame(chain, "repository long, base long, family string, split string")).collect()}
    assert got[999].ancestors == 999 and got[999].problem is None and got[999].cycle is None
    assert {(got[2000 + i].problem, got[2000 + i].cycle, got[2000 + i].ancestors) for i in range(700)} == {("CYCLE", 2000, None)}
    assert got[5000].problem is None and got[5000].ancestors == 1
    empty = spark.createDataFrame([], "repository long, base long, family string, split string")
    assert lineage.lineage_problems(empty).count() == 0


# JSON

TEXTS = {
    '{"a":1}': None, ' {"a":1} \n': None, '{"a":[{"x":1},{"x":2}]}': None, '{"a":"}{\\"a\\""}': None, "{}": None,
    '{"a":1,"a":2}': "REPEATED_KEY", '{"a":1,"b":{"c":1,"c":2}}': "REPEATED_KEY", '{"a":[[{"c":1,"c":2}]]}': "REPEATED_KEY",
    '{"a":1} trailing': "JSON", '{"a":1}, {"b":2}': "JSON", '{"a":1}}': "JSON", '{"a":1}]': "JSON", "1] , [2": "JSON", '1}, {"x":2': "JSON", "[1]": "JSON", "null": "JSON", "": "JSON",
    '{"a":{"b":}}': "JSON", '{"a":NaN}': "JSON", '{"a":1,}': "JSON", "{'a':1}": "JSON",
}


def test_strict_objects(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r.t: r.p for r in df.select("t", object_problem(F.col("t")).alias("p")).collect()}
    assert got == TEXTS
    parsed = {r.t for r in df.filter(strict_json(F.col("t")).isNotNull()).collect()}

    def once(pairs):
        assert len({k for k, _ in pairs}) == len(pairs)
        return dict(pairs)

    def constant(name):
        raise ValueError(name)

    def reads(t):
        try:
            json.loads(t, object_pairs_hook=once, parse_constant=constant)
        except (ValueError, AssertionError):
            return False
        return True

    assert parsed == {t for t in TEXTS if reads(t)}


def test_answers_with_inner_repeats_or_trailing_text_are_refused(spark):
    rows = [(i, 0, "R", [0], ["E"], "fine", t) for i, t in enumerate(['{"a":1,"b":{"c":1,"c":2}}', '{"a":1} trailing', '{"a":1}', None])]
    answers = spark.createDataFrame(rows, "answer long, target long, rule string, subjects array<long>, refs array<string>, text string, json string")
    targets = spark.createDataFrame([(0, 0, "R")], "target long, node long, rule string")
    got = assembly.answer_problems(answers, targets, targets.select("target", "node"), spark.createDataFrame([(0, "E")], "target long, ref string"))
    assert {r.answer: r.problem for r in got.collect()} == {0: "REPEATED_KEY", 1: "JSON", 2: None, 3: "JSON"}


def test_manifests(spark):
    good = {"repository": "r1", "family": "f", "split": "TRAIN", "path": "src/a", "base": None, "more": [1]}
    deep = '{"repositories":[],"x":' + "[" * 40 + "]" * 40 + "}"
    texts = {
        "good": json.dumps({"repositories": [good, {**good, "repository": "r2", "base": "r1"}]}),
        "text": "{", "null": None, "twice": '{"repositories":[{"a":1,"a":1}]}', "deep": deep, "brackets in strings": json.dumps({"repositories": [], "x": "[" * 50}),
        "shape": '{"repositories":{}}', "many": json.dumps({"repositories": [{**good, "repository": f"r{i}"} for i in range(501)]}), "long": '{"repositories":[],"x":"' + "y" * manifests.MAX_BYTES + '"}',
        "items": json.dumps({"repositories": [good, {**good, "split": "HELD"}, {**good, "repository": "r3", "path": "a/../b"}, {**good, "repository": 4}, {"repository": "r5"}, 7]}),
    }
    paths = {"a": False, "a/b.c": False, "": True, "/a": True, "a//b": True, "a/.": True, "..": True, "c:a": True, "a\\b": True, None: True}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "manifest string, text string")
    repositories, problems = manifests.load_manifests(df)
    got = Counter((r.manifest, r.place, r.code) for r in problems.collect())
    want = [("text", None, "JSON"), ("null", None, "JSON"), ("twice", None, "REPEATED_KEY"), ("deep", None, "DEPTH"), ("shape", None, "SHAPE"), ("many", None, "REPOSITORIES"), ("long", None, "SIZE")]
    want += [("items", 0, "REPEATED_REPOSITORY"), ("items", 1, "SPLIT"), ("items", 1, "REPEATED_REPOSITORY"), ("items", 2, "PATH"), ("items", 3, "FIELD"), ("items", 4, "FIELD"), ("items", 5, "FIELD")]
    assert got == Counter(want)
    assert {(r.manifest, r.place, r.repository, r.base) for r in repositories.collect()} == {("good", 0, "r1", None), ("good", 1, "r2", "r1")}
    unsafe = {r.p: r.u for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", manifests.unsafe_path(F.col("p")).alias("u")).collect()}
    assert unsafe == paths
