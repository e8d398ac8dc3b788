"""Bounded taint flow through single functions: from request sources to sinks, file by file.

Values are UNTAINTED, TAINTED, SANITIZED (for some rules) or UNKNOWN. Statements run in order. Both arms of an if start
from the same state and merge; an arm that returns is dropped. Loops, switches and try blocks are not approximated by one
pass: everything assigned in them is UNKNOWN afterwards. A call that is not modelled gives UNKNOWN if an argument
carries anything. A sink reports SUPPORTED for a tainted argument and POTENTIAL for an unknown one that a source may
have reached. Each file is one row in and its reports out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from plumbline.operators.security import SINKS

from .extract import blanked

REPORTS = "path string, rule_id string, state string, api string, line int"
#: Calls and properties that read a request.
SOURCES = re.compile(r"\.(?:getParameter|getHeader|getQueryString|getPathInfo)\s*\(|\b(?:req|request)\.(?:query|params|body|headers)\b")
#: Calls that carry taint from arguments to their value.
CARRIERS = {"join", "resolve", "normalize", "get", "concat", "trim", "toString", "String", "valueOf", "format"}
#: Calls that make a value safe for rules (fixed values).
SANITIZERS = {"sanitize": {"SEC007"}, "encodeForHTML": {"SEC007"}, "escapeHtml": {"SEC007"}}
MAX_STEPS, MAX_BRANCHES = 32, 32

_TAILS = {}
for (_rule, _lang), _apis in SINKS.items():
    if _rule not in ("SEC008", "SEC009"):  # those two do not depend on flow
        for _api in _apis:
            _TAILS.setdefault((_lang, _api.rsplit(".", 1)[-1]), (_rule, _api))
_FUNCTION = re.compile(r"(?:\bfunction\s+\w+\s*|\b(?:public|private|protected|static|async)\s[\w\s<>\[\],.]*?\b\w+\s*|=\s*(?:async\s*)?)\(([^()]*)\)\s*(?::\s*[\w<>\[\]. ]+)?\s*(?:=>\s*)?(?:throws [\w., ]+)?\{|^\s*(?!if|for|while|switch|catch)\w+\s*\(([^()]*)\)\s*\{", re.M)
_ASSIGN = re.compile(r"^\s*(?:(?:const|let|var|final)\s+)?(?:[\w<>\[\].]+\s+)?([A-Za-z_$][\w$]*)\s*(?::[^=]+)?(\+?=)(?!=)\s*(.*)$", re.S)
_CALL = re.compile(r"([A-Za-z_$][\w$]*)\s*\(")

Value = tuple[str, frozenset, int]
CLEAN: Value = ("UNTAINTED", frozenset(), 0)


def merged(values: list[Value]) -> Value:
    """The join of values: unknown wins, then taint; sanitized ones keep the rules that all of them share."""
    live = [v for v in values if v[0] != "UNTAINTED"]
    if not live:
        return CLEAN
    steps = max(v[2] for v in live)
    if any(v[0] == "UNKNOWN" for v in live) or steps > MAX_STEPS or len(live) > MAX_BRANCHES:
        return ("UNKNOWN", frozenset(), steps)
    if any(v[0] == "TAINTED" for v in live):
        return ("TAINTED", frozenset(), steps)
    shared = frozenset.intersection(*[v[1] for v in live])
    return ("SANITIZED" if shared else "TAINTED", shared, steps)


class Flow:
    """The state of one function and what its sinks report."""

    def __init__(self, path: str, language: str, code: str):
        self.path, self.language, self.code = path, language, code
        self.reports: list[tuple] = []

    def value(self, text: str, state: dict[str, Value]) -> Value:
        parts = [("TAINTED", frozenset(), 1)] if SOURCES.search(text) else []
        parts += [state[n] for n in set(re.findall(r"(?<![\w$.])[A-Za-z_$][\w$]*", text)) if n in state]
        out = merged(parts)
        calls = [c for c in _CALL.findall(text) if c not in ("if", "return", "new")]
        for name in calls:
            if name in SANITIZERS and out[0] in ("TAINTED", "SANITIZED"):
                out = ("SANITIZED", frozenset(out[1] | SANITIZERS[name]), out[2] + 1)
        known = all(c in CARRIERS or c in SANITIZERS or SOURCES.search(f".{c}(") or (self.language, c) in _TAILS for c in calls)
        if out[0] != "UNTAINTED":
            out = (out[0] if known else "UNKNOWN", out[1] if known else frozenset(), out[2] + 1)
        return out if out[2] <= MAX_STEPS else ("UNKNOWN", frozenset(), out[2])

    def sinks(self, text: str, state: dict[str, Value], at: int) -> None:
        line = self.code.count("\n", 0, at) + 1
        for m in _CALL.finditer(text):
            found = _TAILS.get((self.language, m[1]))
            if found:
                inside = _balanced(text, m.end() - 1)
                self.report(found, self.value(inside, state), line)
        m = re.search(r"\.(innerHTML|outerHTML)\s*=(?!=)(.*)", text, re.S)
        if m and self.language == "TYPESCRIPT":
            self.report(("SEC007", m[1]), self.value(m[2], state), line)

    def report(self, sink: tuple[str, str], value: Value, line: int) -> None:
        rule, api = sink
        if rule in value[1] or value[0] == "UNTAINTED":
            return
        self.reports.append((self.path, rule, "POTENTIAL" if value[0] == "UNKNOWN" else "SUPPORTED", api, line))

    def block(self, a: int, b: int, state: dict[str, Value]) -> bool:
        """Runs the code in [a, b) on state; true if it returns."""
        i = a
        while i < b:
            m = re.compile(r"\s*(if|for|while|do|switch|try|return|throw)\b|\s*\{|\s*\}|\s*;").match(self.code, i, b)
            word = m[1] if m else None
            if m and word is None:
                i = m.end()
            elif word == "if":
                i = self._branch(m.end(), b, state)
            elif word in ("for", "while", "do", "switch", "try"):
                i = self._opaque(m.end(), b, state)
            else:
                end = _statement(self.code, i, b)
                text = self.code[i:end]
                self.sinks(text, state, i + len(text) - len(text.lstrip()))
                if word in ("return", "throw"):
                    return True
                got = _ASSIGN.match(text)
                if got:
                    value = self.value(got[3], state)
                    state[got[1]] = merged([state.get(got[1], CLEAN), value]) if got[2] == "+=" else value
                i = end + 1
        return False

    def _arm(self, i: int, b: int) -> tuple[int, int, int]:
        """(begin, end, next) of the block or statement at i."""
        m = re.compile(r"\s*\{").match(self.code, i, b)
        if m:
            end = _close(self.code, m.end() - 1, b)
            return m.end(), end, end + 1
        end = _statement(self.code, i, b)
        return i, min(end + 1, b), end + 1

    def _branch(self, i: int, b: int, state: dict[str, Value]) -> int:
        paren = self.code.index("(", i)
        end = _close(self.code, paren, b)
        self.sinks(self.code[paren:end], state, paren)
        x, y, i = self._arm(end + 1, b)
        arms = [dict(state)]
        done = [self.block(x, y, arms[0])]
        m = re.compile(r"\s*else\b").match(self.code, i, b)
        if m:
            x, y, i = self._arm(m.end(), b)
            arms.append(dict(state))
            done.append(self.block(x, y, arms[1]))
        else:
            arms.append(dict(state))
            done.append(False)
        live = [s for s, d in zip(arms, done, strict=True) if not d]
        names = {n for s in live for n in s}
        state.update({n: merged([s.get(n, CLEAN) for s in live]) for n in names})
        return i

    def _opaque(self, i: int, b: int, state: dict[str, Value]) -> int:
        """A loop, switch or try: what it assigns, and all that is tracked and tainted, is unknown."""
        brace, semi = self.code.find("{", i, b), _statement(self.code, i, b)
        end = _close(self.code, brace, b) if brace >= 0 and brace <= semi else semi
        inside = self.code[i:end]
        for n in list(state):
            if state[n][0] != "UNTAINTED" or re.search(rf"(?<![\w$.]){re.escape(n)}\s*\+?=(?!=)", inside):
                state[n] = ("UNKNOWN", frozenset(), state[n][2])
        if SOURCES.search(inside):
            for m in re.finditer(r"([A-Za-z_$][\w$]*)\s*\+?=(?!=)", inside):
                state[m[1]] = ("UNKNOWN", frozenset(), 1)
        self.sinks(inside, state, i)
        return end + 1


def _close(code: str, at: int, b: int) -> int:
    """The place of the bracket that closes the one at `at`."""
    depth = 0
    for k in range(at, b):
        depth += (code[k] in "([{") - (code[k] in ")]}")
        if not depth:
            return k
    return b


def _balanced(text: str, at: int) -> str:
    return text[at : _close(text, at, len(text)) + 1]


def _statement(code: str, i: int, b: int) -> int:
    """The place of the semicolon, or the closing brace, that ends the statement at i."""
    depth = 0
    for k in range(i, b):
        c = code[k]
        depth += (c in "([{") - (c in ")]}")
        if depth < 0 or (c == ";" and not depth):
            return k
    return b


def reports(path: str, text: str) -> list[tuple]:
    """What the sinks of one file report, each once."""
    language = "JAVA" if path.endswith(".java") else "TYPESCRIPT"
    code, _ = blanked(text)
    out, done = [], 0
    for m in _FUNCTION.finditer(code):
        if m.start() < done:
            continue
        done = _close(code, m.end() - 1, len(code))
        flow = Flow(path, language, code)
        flow.block(m.end(), done, {})
        out += flow.reports
    return sorted(set(out))


def analyze(files: DataFrame) -> DataFrame:
    """files (path, content binary) -> REPORTS; a file that cannot be analysed reports rule_id PROBLEM rather than nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in REPORTS.split(", ")]
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = reports(path, bytes(data or b"").decode("utf-8"))
                except (UnicodeDecodeError, ValueError, RecursionError) as e:
                    rows = [(path, "PROBLEM", type(e).__name__, None, None)]
                yield pd.DataFrame(rows, columns=columns).astype({"line": "Int32"})

    return files.select("path", "content").mapInPandas(run, REPORTS)
