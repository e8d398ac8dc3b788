"""Archives, analysis coverage, evidence packs, ties and fragments against brute force and literal cases."""

import hashlib
import random
import statistics
import zipfile
from collections import Counter

import pytest

from plumbline.operators import fusion, orchestration, packs, ranks
from plumbline.sources import archives, intake

# archives


def test_archive_in_blocks(spark, tmp_path):
    """10,000 entries are read by many tasks, each of about a block."""
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("dir/", "")
        for i in range(10_000):
            z.writestr(f"dir/f{i}.ts", f"const x = {i};" * 20)
    entries = archives.directory(spark, str(tmp_path / "many.zip"))
    assert "content" not in entries.columns and entries.count() == 10_000
    total = entries.selectExpr("sum(size_bytes)").first()[0]
    read = archives.contents(entries, block_bytes=total // 40)
    assert read.rdd.getNumPartitions() >= 30
    spread = [r["count"] for r in read.selectExpr("spark_partition_id() p").groupBy("p").count().collect()]
    assert len(spread) >= 30 and max(spread) <= 1_500
    got = {r["path"]: bytes(r["content"]) for r in read.collect()}
    assert got == {f"dir/f{i}.ts": (f"const x = {i};" * 20).encode() for i in range(10_000)}


def test_damaged_archives_and_limits(spark, tmp_path):
    for name in ("good.zip", "bad.zip"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for i in range(5):
                z.writestr(f"{i}.ts", f"entry {i} of {name}")
    data = bytearray((tmp_path / "bad.zip").read_bytes())
    at = data.index(b"entry 2")
    data[at] = 0  # its checksum fails
    (tmp_path / "bad.zip").write_bytes(bytes(data))
    (tmp_path / "none.zip").write_bytes(b"no archive")
    (tmp_path / "empty.zip").write_bytes(b"")
    rows = intake.scan_zip(spark, str(tmp_path / "*.zip")).collect()
    assert Counter((r["archive"].rsplit("/", 1)[1], r["problem"]) for r in rows) == {
        ("good.zip", None): 5, ("bad.zip", None): 4, ("bad.zip", "damaged"): 1, ("none.zip", "damaged"): 1,
    }
    assert [r["path"] for r in rows if r["problem"] and "bad" in r["archive"]] == ["2.ts"]
    good = str(tmp_path / "good.zip")
    assert {r["path"]: r["problem"] for r in archives.directory(spark, good, max_entries=3).collect()} == {"0.ts": None, "1.ts": None, "2.ts": None, "3.ts": "limit"}
    size = len("entry 0 of good.zip")
    assert [r["problem"] for r in archives.directory(spark, good, max_bytes=2 * size).orderBy("ordinal").collect()] == [None, None, "limit", "limit", "limit"]


# coverage


@pytest.fixture(scope="module")
def covered(spark):
    requests = [(s, "JAVA", r) for s in ("fine", "limit", "bytes", "other", "broken", "twice", "none", "detector") for r in ("SEC001", "SEC002")] + [("fine", "JAVA", "SEC099"), ("fine", "JAVA", "SEC001")]
    files = [("fine", 0, "a", "JAVA", 5, None), ("fine", 1, "b", "JAVA", 5, None), ("detector", 0, "a", "JAVA", 5, None)]
    files += [("limit", i, f"f{i}", "JAVA", 1, None) for i in range(5)] + [("bytes", 0, "a", "JAVA", 8, None), ("bytes", 1, "b", "JAVA", 3, None), ("bytes", 2, "c", "GO", 0, None)]
    files += [("other", 0, "a", None, 1, None), ("other", 1, "b", "JAVA", 1, None), ("broken", 0, "a", "JAVA", 1, "SOURCE_PARSE_ERROR")]
    files += [("twice", 0, "a", "JAVA", 1, None), ("twice", 1, "a", "JAVA", 1, None), ("unasked", 0, "a", "JAVA", 1, None)]
    findings = [("fine", "SEC001", 1), ("fine", "SEC001", 1), ("fine", "SEC001", 2), ("fine", "SEC099", 3), ("broken", "SEC001", 4)]
    return orchestration.coverage(
        spark.createDataFrame(requests, "snapshot string, language string, rule string"),
        spark.createDataFrame([("JAVA", "SEC001"), ("JAVA", "SEC002"), ("GO", "SEC099")], "language string, rule string"),
        spark.createDataFrame(files, "snapshot string, seq int, path string, language string, size long, problem string"),
        spark.createDataFrame(findings, "snapshot string, rule string, finding long"),
        spark.createDataFrame([("detector", "SEC002"), ("broken", "SEC001")], "snapshot string, rule string"), 4, 10,
    )


def test_rule_coverage(covered):
    got = {(r.snapshot, r.rule): (r.status, r.units, r.findings, r.diagnostics) for r in covered.collect()}
    assert len(got) == covered.count() == 17
    codes = "PARTIAL_ANALYSIS,UNSUPPORTED_RULE"
    assert got["fine", "SEC001"] == (orchestration.EVALUATED, 2, 2, codes) and got["fine", "SEC002"] == (orchestration.EVALUATED, 2, 0, codes)
    assert got["fine", "SEC099"] == (orchestration.UNSUPPORTED, 2, 0, codes)
    assert got["limit", "SEC001"] == (orchestration.FAILED, 4, 0, "PARTIAL_ANALYSIS,SOURCE_INTAKE_LIMIT")
    # what comes after the source that is over the limit is not looked at
    assert got["bytes", "SEC001"] == (orchestration.FAILED, 1, 0, "PARTIAL_ANALYSIS,SOURCE_INTAKE_LIMIT")
    assert got["other", "SEC002"] == (orchestration.FAILED, 1, 0, "PARTIAL_ANALYSIS,UNSUPPORTED_LANGUAGE")
    assert got["broken", "SEC001"] == (orchestration.FAILED, 0, 0, "PARTIAL_ANALYSIS,SOURCE_PARSE_ERROR,SOURCE_UNAVAILABLE")
    assert got["none", "SEC001"] == (orchestration.FAILED, 0, 0, "PARTIAL_ANALYSIS,SOURCE_UNAVAILABLE")
    assert got["twice", "SEC001"][0] == orchestration.REFUSED and got["twice", "SEC001"][3] == "DUPLICATE_SOURCE"
    assert got["detector", "SEC001"] == (orchestration.EVALUATED, 1, 0, "DETECTOR_ERROR,PARTIAL_ANALYSIS") and got["detector", "SEC002"][0] == orchestration.FAILED


def test_results_and_observation(covered):
    r = {r.snapshot: r for r in orchestration.results(covered).collect()}
    assert (r["fine"].requested_rules, r["fine"].analyzed_rules, r["fine"].applicable_rules, r["fine"].unsupported_rules) == ("SEC001,SEC002,SEC099", "SEC001,SEC002", "SEC001", "SEC099")
    assert r["detector"].unsupported_rules == "SEC002" and r["none"].analyzed_rules == ""
    rows, seen = orchestration.observed(covered)
    rows.collect()
    assert seen.get == {"rules": 17, orchestration.EVALUATED: 3, orchestration.FAILED: 11, orchestration.UNSUPPORTED: 1, orchestration.REFUSED: 2, "findings": 2}


# packs


def brute(items, parts):
    """Fingerprints by recursion from the roots."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    out = {}

    def visit(pack, level):
        inside = [visit(p, level + 1) for p, q in parts if q == pack]
        own = [sha("none" if c is None else f"item:{c}") for p, c in items if p == pack]
        digests = own + [sha(f"pack:{h}") for h, _ in inside]
        sums = [sum(int(d[8 * i : 8 * i + 8], 16) for d in digests) for i in range(8)]
        out[pack] = sha("|".join(map(str, [len(own), len(inside), *sums]))), level, len(own) + sum(n for _, n in inside)
        return out[pack][0], out[pack][2]

    for p, q in parts:
        if q is None:
            visit(p, 0)
    return out


def rolled(spark, items, parts):
    rows = packs.fingerprints(spark.createDataFrame(items, "pack string, content string"), spark.createDataFrame(parts, "pack string, parent string"))
    return rows, {r.pack: (r.fingerprint, r.level, r.below) for r in rows.collect()}


def test_nested_packs(spark):
    r = random.Random(2)
    parts = [("p0", None), ("p1", None)] + [(f"p{i}", f"p{r.randrange(i)}") for i in range(2, 40)]
    items = [(f"p{r.randrange(40)}", r.choice(["a", "b", "", None, "long" * 50])) for _ in range(300)]
    lost = [("x", "y"), ("y", "x"), ("below", "x"), ("orphan", "nowhere")]
    before, got = rolled(spark, items, parts + lost)
    want = brute(items, parts)
    assert {p: v for p, v in got.items() if v[1] is not None} == want
    assert {p for p, v in got.items() if v == (None, None, None)} == {"x", "y", "below", "orphan"}
    # order does not matter; one changed item changes the packs above it and no other
    r.shuffle(items)
    assert rolled(spark, items, parts + lost)[1] == got
    above, at = set(), "p39"
    while at is not None:
        above.add(at)
        at = dict(parts)[at]
    after, _ = rolled(spark, items + [("p39", "new")], parts + lost[:3] + [("more", "p5")])
    status = {x.pack: x.status for x in packs.changes(before, after).collect()}
    at = "p5"
    while at is not None:
        above.add(at)
        at = dict(parts)[at]
    assert {p for p, s in status.items() if s == "CHANGED"} == above
    assert status["more"] == "ADDED" and status["orphan"] == "REMOVED" and status["x"] == "SAME"


def test_equal_packs_and_empty_tables(spark):
    _, got = rolled(spark, [("a", "1"), ("a", "2"), ("b", "2"), ("b", "1"), ("c", "1"), ("c", "1")], [("a", None), ("b", None), ("c", None), ("d", None), ("e", "d")])
    assert got["a"][0] == got["b"][0] != got["c"][0] and got["d"][0] != got["e"][0] and got["e"][2] == 0
    assert rolled(spark, [], [])[1] == {} and rolled(spark, [("a", "1")], [])[1] == {}


# ties and ranges


def test_quantiles_of_ties(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "cold", None]), r.choice([1.5, 1.5, 1.5, 2.0, 9.0, None])) for _ in range(5_000)] + [("one", 3.0), ("nothing", None)]
    got = {x.g: (x.n, x.median, x.p95) for x in ranks.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        own = sorted(v for h, v in rows if h == g and v is not None)
        if own:
            want[g] = len(own), statistics.median(own), own[(95 * len(own) + 99) // 100 - 1]
    assert got == want


def test_fragments_of_one_file(spark):
    r = random.Random(6)
    rows = [("f", p, s := r.randrange(1, 4_000), s + r.randrange(0, 200)) for p in range(1_500)]
    kept = []
    for _, p, s, e in sorted(rows, key=lambda x: x[1:]):
        a = max(1, s - 2)
        b = min(e + 2, a + 119)
        if all(b < x or a > y for x, y, _ in kept):
            kept.append((a, b, p))
    got = fusion.fragments(spark.createDataFrame(rows, "file string, priority long, start long, end long"))
    assert sorted((x.start, x.end, x.priority) for x in got.collect()) == sorted(kept)
