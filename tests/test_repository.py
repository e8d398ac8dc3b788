"""From source trees to findings."""

from plumbline.operators import conformance as C
from plumbline.plans import repository

CONTROLLER = "package shop.web;\nimport shop.db.Repo;\npublic class Ctl {\n  public void go() { new Repo(); }\n}\n"
REPO = "package shop.db;\npublic class Repo {\n  public void save() { }\n}\n"
SCOPES = (C.Scope("layer", "web", ("**/web/**",)), C.Scope("layer", "db", ("**/db/**",)), C.Scope("layer", "app", ("**/app/**",)))
RULES = (C.Rule("no-db", "layer", "web", allow=("app",)),)


def tree(tmp_path, files):
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return str(tmp_path)


def test_violation_and_clean(spark, tmp_path):
    root = tree(tmp_path / "a", {"src/shop/web/Ctl.java": CONTROLLER, "src/shop/db/Repo.java": REPO})
    out = repository.check(spark, root, SCOPES, RULES)
    got = out["findings"].collect()
    assert [(r["rule_id"], r["source"], r["target"], r["occurrences"], r["relations"]) for r in got] == [("no-db", "src/shop/web/Ctl.java", "src/shop/db/Repo.java", 2, "CREATES,IMPORTS")]
    assert out["status"].first()["status"] == "NON_CONFORMANT"
    clean = tree(tmp_path / "b", {"src/shop/db/Repo.java": REPO})
    assert repository.check(spark, clean, SCOPES, RULES)["status"].first()["status"] == "CONFORMANT"


def test_ambiguous_scopes_and_bad_files(spark, tmp_path):
    root = tree(tmp_path / "a", {"src/shop/web/Ctl.java": CONTROLLER, "src/shop/db/Repo.java": REPO})
    twice = (*SCOPES, C.Scope("layer", "all", ("src/**",)))
    out = repository.check(spark, root, twice, RULES)
    assert out["findings"].count() == 0 and out["status"].first()["status"] == "INVALID"
    bad = tree(tmp_path / "b", {"src/shop/db/Repo.java": "a\0b"})
    assert repository.check(spark, bad, SCOPES, RULES)["status"].first()["status"] == "INCOMPLETE"


def test_cycle_of_modules(spark, tmp_path):
    root = tree(tmp_path, {"src/a.ts": "import { b } from './b';\nexport const a = () => b();\n", "src/b.ts": "import { c } from './c';\n", "src/c.ts": "import { a } from './a';\nimport { z } from 'lib';\n"})
    out = repository.check(spark, root, SCOPES, (), cycle_rule="ARCH003")
    assert [(r["size"], r["trace"]) for r in out["cycles"].collect()] == [(3, "src/a.ts -> src/b.ts -> src/c.ts -> src/a.ts")]
    assert out["status"].first()["status"] == "NON_CONFORMANT"


def test_ambiguity_makes_no_edge(spark, tmp_path):
    root = tree(tmp_path, {"src/x/A.java": "package x;\nclass A { void f() { new Thing(); } }", "src/y/Thing.java": "package y;\nclass Thing { }", "src/z/Thing.java": "package z;\nclass Thing { }"})
    parts = repository.model(spark, root)
    got = {(r["name"], r["status"], r["method"]) for r in parts["references"].collect()}
    assert ("Thing", "AMBIGUOUS", "GLOBAL") in got and parts["edges"].count() == 0
