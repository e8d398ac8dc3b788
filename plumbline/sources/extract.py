"""Lexical facts of Java and TypeScript/JavaScript files: declarations, imports, references.

A scanner, not a parser: comments and strings are blanked, braces give containers, patterns give facts. What needs a
syntax tree (overload types, shadowing in nested scopes, computed calls) is left out rather than guessed.
Each file is one row in and its facts out, so a scan is a parallel map without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FACTS = "path string, fact string, kind string, name string, container string, target string, line int, arguments int"
MAX_BYTES, MAX_FACTS = 2 << 20, 50_000

_JAVA_TYPE = re.compile(r"\b(class|interface|enum|record)\s+([A-Za-z_]\w*)(?:\s*<[^{>]*>)?(?:\s+extends\s+([\w.]+))?(?:\s+implements\s+([\w.,\s]+?))?\s*\{")
_JAVA_METHOD = re.compile(r"(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+(?:<[^>]+>\s*)?(?:[\w.<>\[\],?]+\s+)?([A-Za-z_]\w*)\s*\(([^()]*)\)\s*(?:throws [\w.,\s]+)?[{;]")
_JAVA_IMPORT = re.compile(r"^\s*import\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;", re.M)
_ANNOTATION = re.compile(r"@([A-Z]\w*)")
_ES_TYPE = re.compile(r"\b(class|interface|enum)\s+([A-Za-z_$]\w*)(?:\s*<[^{>]*>)?(?:\s+extends\s+([\w.$]+))?(?:\s+implements\s+([\w.,$\s]+?))?\s*\{")
_ES_FUNCTION = re.compile(r"\bfunction\s+([A-Za-z_$]\w*)\s*\(([^()]*)\)|\b(?:const|let)\s+([A-Za-z_$]\w*)\s*=\s*(?:async\s*)?\(([^()]*)\)\s*(?::[^=]+)?=>")
_ES_IMPORT = re.compile(r"\bimport\s+(?:type\s+)?(?:([\w$*{},\s]+?)\s+from\s+)?(['\"])(@@\d+)\2|\brequire\(\s*(['\"])(@@\d+)\4\s*\)")
_CALL = re.compile(r"(?<![\w.$])((?:[A-Za-z_$][\w$]*\.)*)([A-Za-z_$][\w$]*)\s*\(")
_NEW = re.compile(r"\bnew\s+([A-Za-z_$][\w.$]*)\s*(?:<[^>()]*>)?\s*\(")
_MARKS = re.compile(r"[()\[\]{},]|[^\s()\[\]{},]+")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "super", "this", "synchronized", "require", "import", "constructor"}


def blanked(text: str) -> tuple[str, list[str]]:
    """text with comments as spaces and each string's content as @@number; the contents."""
    strings: list[str] = []

    def sub(m: re.Match) -> str:
        if m[1]:
            return re.sub(r"[^\n]", " ", m[0])
        strings.append(m[0][1:-1])
        return f"{m[0][0]}@@{len(strings) - 1}{m[0][0]}" + "\n" * m[0].count("\n")

    return re.sub(r"(//[^\n]*|/\*.*?\*/)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", sub, text, flags=re.S), strings


def _arguments(text: str, at: int) -> int:
    """The number of arguments of the call whose parenthesis opens at `at`, read up to the one that closes it."""
    depth, commas, some = 0, 0, False
    for m in _MARKS.finditer(text, at):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                break
        elif depth == 1 and c == ",":
            commas += 1
        if depth and not c.isspace() and not (depth == 1 and c == "("):
            some = True
    return commas + 1 if some else 0


def facts(path: str, text: str) -> list[tuple]:
    """The facts of one file: (path, fact, kind, name, container, target, line, arguments)."""
    java = path.endswith(".java")
    code, strings = blanked(text)
    line = lambda at: code.count("\n", 0, at) + 1
    out, spans = [], []
    package = re.search(r"^\s*package\s+([\w.]+)\s*;", code, re.M) if java else None
    prefix = f"{package[1]}." if package else ""
    for m in (_JAVA_TYPE if java else _ES_TYPE).finditer(code):
        depth, end = 0, len(code)
        for k in range(m.end() - 1, len(code)):
            depth += (code[k] == "{") - (code[k] == "}")
            if not depth:
                end = k
                break
        outer = next((s for s in reversed(spans) if s[0] < m.start() < s[1]), None)
        name = f"{outer[2]}.{m[2]}" if outer else prefix + m[2]
        spans.append((m.start(), end, name))
        out.append((path, "DECLARATION", m[1].upper(), name, outer[2] if outer else None, None, line(m.start()), None))
        if m[3]:
            out.append((path, "REFERENCE", "EXTENDS", m[3], name, None, line(m.start()), None))
        for x in (m[4] or "").split(","):
            if x.strip():
                out.append((path, "REFERENCE", "EXTENDS" if m[1] == "interface" else "IMPLEMENTS", x.strip(), name, None, line(m.start()), None))

    def owner(at: int) -> str | None:
        inside = [s for s in spans if s[0] < at < s[1]]
        return max(inside)[2] if inside else None

    for m in (_JAVA_METHOD if java else _ES_FUNCTION).finditer(code):
        name, params = (m[1], m[2]) if m[1] else (m[3], m[4])
        own = owner(m.start())
        n = len([p for p in params.split(",") if p.strip()])
        kind = ("CONSTRUCTOR" if own and own.rsplit(".", 1)[-1] == name else "METHOD") if java else "FUNCTION"
        out.append((path, "DECLARATION", kind, f"{own}.{name}" if own else name, own, None, line(m.start()), n))
    if java:
        for m in _JAVA_IMPORT.finditer(code):
            out.append((path, "IMPORT", "STATIC" if m[1] else "WILDCARD" if m[2].endswith("*") else "TYPE", m[2].rsplit(".", 1)[-1], None, m[2], line(m.start()), None))
    else:
        for m in _ES_IMPORT.finditer(code):
            spec = strings[int((m[3] or m[5])[2:])]
            names = re.findall(r"[\w$]+(?:\s+as\s+[\w$]+)?|\*\s+as\s+[\w$]+", (m[1] or "").replace("{", " ").replace("}", " ")) or [None]
            for x in names:
                out.append((path, "IMPORT", "REQUIRE" if m[5] else "MODULE", x.split()[-1] if x else None, None, spec, line(m.start()), None))
    for m in _ANNOTATION.finditer(code):
        out.append((path, "ANNOTATION", "ANNOTATION", m[1], owner(code.find("{", m.end()) + 1), None, line(m.start()), None))
    news = set()
    for m in _NEW.finditer(code):
        news.add(m.start(1))
        out.append((path, "REFERENCE", "CREATE", m[1], owner(m.start()), None, line(m.start()), _arguments(code, m.end() - 1)))
    declared = {m.start(1) for m in _JAVA_METHOD.finditer(code)} if java else {m.start(1) for m in _ES_FUNCTION.finditer(code)}
    for m in _CALL.finditer(code):
        if m[2] not in _WORDS and m.start() not in news and m.start(2) not in declared and m.start(1) not in news:
            out.append((path, "REFERENCE", "CALL", m[1] + m[2], owner(m.start()), None, line(m.start()), _arguments(code, m.end() - 1)))
    return out


def extract(files: DataFrame) -> DataFrame:
    """files (path, content binary) -> FACTS; a file that is too large, not UTF-8, holds NUL, or has too many facts gives one
    PROBLEM row instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FACTS.split(", ")]
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                data, problem, rows = bytes(data or b""), None, []
                if len(data) > MAX_BYTES:
                    problem = "TOO_LARGE"
                elif b"\0" in data:
                    problem = "BINARY"
                else:
                    try:
                        rows = facts(path, data.decode("utf-8"))
                        problem = "TOO_MANY_FACTS" if len(rows) > MAX_FACTS else None
                    except UnicodeDecodeError:
                        problem = "ENCODING"
                if problem:
                    rows = [(path, "PROBLEM", problem, None, None, None, None, None)]
                out = pd.DataFrame(rows, columns=columns)
                yield out.astype({"line": "Int32", "arguments": "Int32"})

    return files.select("path", "content").mapInPandas(run, FACTS)
