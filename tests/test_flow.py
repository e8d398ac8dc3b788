"""Taint flow through small functions."""

import pytest

from plumbline.sources import flow


def ts(body):
    return [(r, s, a) for _, r, s, a, _ in flow.reports("a.ts", f"function f(req) {{ {body} }}")]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("const x = req.query.id; pool.query('a' + x);", [("SEC002", "SUPPORTED", "pg.Client.query")]),
        ("const x = 'fixed'; pool.query('a' + x);", []),
        ("const x = req.body; const y = DOMPurify.sanitize(x); el.innerHTML = y;", []),
        ("const x = req.body; const y = DOMPurify.sanitize(x); eval(y);", [("SEC010", "SUPPORTED", "eval")]),
        ("const x = req.body; const y = custom(x); eval(y);", [("SEC010", "POTENTIAL", "eval")]),
        ("let x = 'a'; if (c) { x = req.body; } eval(x);", [("SEC010", "SUPPORTED", "eval")]),
        ("let x = req.body; if (c) { x = 'a'; } else { x = 'b'; } eval(x);", []),
        ("let x = 'a'; if (c) { x = req.body; return; } eval(x);", []),
        ("let x = 'a'; for (const y of z) { x = req.body; } eval(x);", [("SEC010", "POTENTIAL", "eval")]),
        ("const p = path.join('/d', req.params.n); fs.readFile(p);", [("SEC004", "SUPPORTED", "fs.readFile")]),
        ("const s = 'eval(req.body)'; // eval(req.body);\n g(s);", []),
    ],
)
def test_cases(body, want):
    assert ts(body) == want


def test_java():
    code = "class A { public void f(HttpServletRequest r) { String q = r.getParameter(\"id\"); st.executeQuery(\"select \" + q); } }"
    assert [(r, s) for _, r, s, _, _ in flow.reports("A.java", code)] == [("SEC002", "SUPPORTED")]


def test_merge_table():
    t, u, s = ("TAINTED", frozenset(), 1), ("UNKNOWN", frozenset(), 1), lambda *r: ("SANITIZED", frozenset(r), 1)
    assert flow.merged([]) == flow.CLEAN and flow.merged([t, u])[0] == "UNKNOWN" and flow.merged([t, s("a")])[0] == "TAINTED"
    assert flow.merged([s("a", "b"), s("b")])[:2] == ("SANITIZED", frozenset({"b"})) and flow.merged([s("a"), s("b")])[0] == "TAINTED"
    assert flow.merged([t] * 33)[0] == "UNKNOWN"


def test_frame(spark):
    df = spark.createDataFrame([("a.ts", bytearray(b"function f(req) { eval(req.body); }")), ("b.ts", bytearray(b"\xff"))], "path string, content binary")
    got = {(r["path"], r["rule_id"], r["state"]) for r in flow.analyze(df).collect()}
    assert got == {("a.ts", "SEC010", "SUPPORTED"), ("b.ts", "PROBLEM", "UnicodeDecodeError")}
