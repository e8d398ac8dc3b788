"""Intake, lexical facts, sinks and the streaming extension on small trees made here."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.sources import extract, intake
from plumbline.streaming.edges import windowed_edges

JAVA = """package shop.web;
import shop.app.OrderService;
import static java.util.Objects.requireNonNull;
import java.util.*;
// class Commented { }
@RestController
public class OrderController extends Base implements Api, Other {
    private final OrderService service = new OrderService("a, b", 2);
    public String show(int id, String name) {
        String text = "class Quoted { call(1) }";
        return service.find(id, wrap(name));
    }
    public OrderController() { }
}
"""
TS = """import { find as lookup, Repo } from './repo';
import * as fs from 'fs';
const db = require("pg");
export class Service extends Base implements Port {
  run() { return lookup(fs.readFile('x')); }
}
export const handler = (a, b) => new Service();
function plain(x) { return x; }
"""


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for path, text in {"src/main/java/shop/web/OrderController.java": JAVA, "src/app/service.ts": TS, "src/app/service.spec.ts": "x()", "package.json": "{}", "README.md": "hi", "node_modules/a/index.js": "a()", "logo.png": "\0", "bad.ts": "a\0b"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


def test_scan_classify_and_exclude(spark, tree):
    files = intake.classified(intake.scan(spark, tree))
    got = {r["path"]: (r["kind"], r["language"], r["analysis_eligible"]) for r in files.collect()}
    assert got["src/main/java/shop/web/OrderController.java"] == ("SOURCE", "JAVA", True)
    assert got["src/app/service.spec.ts"] == ("TEST", "TYPESCRIPT", True)
    assert got["package.json"][0] == "MANIFEST" and got["README.md"][0] == "DOCUMENTATION" and got["logo.png"][0] == "BINARY"
    why = {r["path"]: r["why"] for r in files.select("path", intake.excluded_by(F.col("path"), ["**/*.md"], ["*.png", "src/app", "!service.ts"]).alias("why")).collect()}
    assert why["node_modules/a/index.js"] == "DEFAULT" and why["README.md"] == "CUSTOM" and why["logo.png"] == why["src/app/service.spec.ts"] == "GITIGNORE"
    assert why["src/app/service.ts"] is None
    roots = {(r["root"], r["is_test"]) for r in intake.source_roots(files).collect()}
    assert {("src/main/java", False), ("src", False), ("src", True)} <= roots


def test_hash_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("s", "a", 6, "SOURCE"), ("s", "b", 5, "SOURCE"), ("s", "c", 4, "SOURCE"), ("s", "d", 99, "SOURCE"), ("s", "e", 1, "BINARY")], "snap string, path string, size_bytes long, kind string")
    assert [r["hash_status"] for r in intake.hash_budget(df, "snap", 50, 10).orderBy("path").collect()] == ["HASHED", "BUDGET", "HASHED", "TOO_LARGE", "BINARY"]


def test_facts(spark, tree):
    rows = extract.extract(intake.scan(spark, tree)).collect()
    java = {(r["fact"], r["kind"], r["name"]) for r in rows if r["path"].endswith(".java")}
    c = "shop.web.OrderController"
    assert {("DECLARATION", "CLASS", c), ("DECLARATION", "METHOD", f"{c}.show"), ("DECLARATION", "CONSTRUCTOR", f"{c}.OrderController"), ("REFERENCE", "EXTENDS", "Base"), ("REFERENCE", "IMPLEMENTS", "Api"), ("REFERENCE", "IMPLEMENTS", "Other")} <= java
    assert {("IMPORT", "TYPE", "OrderService"), ("IMPORT", "STATIC", "requireNonNull"), ("IMPORT", "WILDCARD", "*"), ("REFERENCE", "CREATE", "OrderService"), ("REFERENCE", "CALL", "service.find"), ("REFERENCE", "CALL", "wrap"), ("ANNOTATION", "ANNOTATION", "RestController")} <= java
    assert not {n for _, _, n in java if n in ("Commented", "Quoted", "call")}
    calls = {r["name"]: r["arguments"] for r in rows if r["fact"] == "REFERENCE" and r["arguments"] is not None}
    assert calls["service.find"] == 2 and calls["OrderService"] == 2 and calls["wrap"] == 1 and calls["Service"] == 0
    ts = {(r["fact"], r["kind"], r["name"], r["target"]) for r in rows if r["path"] == "src/app/service.ts"}
    assert {("IMPORT", "MODULE", "lookup", "./repo"), ("IMPORT", "MODULE", "Repo", "./repo"), ("IMPORT", "MODULE", "fs", "fs"), ("IMPORT", "REQUIRE", None, "pg"), ("DECLARATION", "CLASS", "Service", None), ("DECLARATION", "FUNCTION", "handler", None), ("DECLARATION", "FUNCTION", "plain", None), ("REFERENCE", "CALL", "fs.readFile", None)} <= ts
    assert [r["kind"] for r in rows if r["path"] == "bad.ts"] == ["BINARY"]


def test_zip_scan_refuses_unsafe_entries(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("a/b.ts", "../up.ts", "A/B.ts", "/root.ts"):
            z.writestr(name, "x")
    (tmp_path / "r.zip").write_bytes(data.getvalue())
    got = {r["path"]: (r["problem"], r["content"]) for r in intake.scan_zip(spark, str(tmp_path / "r.zip")).collect()}
    assert got["a/b.ts"] == (None, bytearray(b"x")) and got["../up.ts"][0] == "path" and got["A/B.ts"][0] == "case" and got["/root.ts"][0] == "path"


def test_json_sink_and_specification(spark, tmp_path):
    out = str(tmp_path / "o")
    intake.write_json(spark.createDataFrame([(1 / 3, 1)], "b double, a int"), out)
    parts = sorted((tmp_path / "o").glob("*.json"))  # empty parts may stand beside the one with the row
    assert "".join(p.read_text() for p in parts) == '{"a":1,"b":0.333333333333}\n'
    assert intake.load_specification('{"a": 1}') == {"a": 1}
    for wrong in ('{"a": 1, "a": 2}', '{"x": "' + "y" * 200_000 + '"}'):
        with pytest.raises(ValueError):
            intake.load_specification(wrong)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 5:02d}:{i % 60:02d}:00", "click" if i % 3 else "view") for i in range(300)]
    df = spark.createDataFrame(rows, "user_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = windowed_edges(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), late="10 hours")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("edges").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    key = lambda d: sorted((r["start"], r["event_type"], r["occurrences"]) for r in d.collect())
    assert key(spark.table("edges")) == key(windowed_edges(df))
