"""A reader of the plain part of YAML that specifications are written in.

Block and flow mappings and sequences, plain and quoted scalars, block scalars and comments. What lets a small file mean much, or
something else than it says, is an error: anchors, aliases, tags, merge keys, repeated keys, numbers that are not decimal, tabs as
indentation, and more depth or nodes than the limits.
"""

from __future__ import annotations

import json
import re

_INT = re.compile(r"[-+]?[0-9][0-9_]*$")
_ODD = re.compile(r"[-+]?0[xob][0-9a-fA-F_]+$|[-+]?[0-9]+(:[0-5]?[0-9])+$")
_FLOAT = re.compile(r"[-+]?(?:[0-9][0-9_]*\.[0-9_]*|\.[0-9_]+)(?:[eE][-+]?[0-9]+)?$|[-+]?\.(?:inf|Inf|INF)$|\.(?:nan|NaN|NAN)$")
_WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None}
_WORDS |= {form: value for word, value in (("true", True), ("yes", True), ("on", True), ("false", False), ("no", False), ("off", False)) for form in (word, word.title(), word.upper())}
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#"'\[\]{},&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?=\s|$)""")


class SpecificationError(ValueError):
    pass


class _Lines:
    def __init__(self, text: str, max_depth: int, max_nodes: int):
        self.max_depth, self.left = max_depth, max_nodes
        self.rows: list[tuple[int, str]] = []  # indentation and content; blank and comment lines as (-1, line)
        for raw in text.splitlines():
            body = raw.lstrip(" ")
            if body.startswith("\t") and body.strip():
                raise SpecificationError("tabs are no indentation")
            empty = not body.strip() or body.startswith("#")
            self.rows.append((-1 if empty else len(raw) - len(body), raw if empty else body.rstrip()))
        self.at = 0

    def node(self, depth: int) -> None:
        self.left -= 1
        if depth > self.max_depth or self.left < 0:
            raise SpecificationError("too deep or too many nodes")

    def peek(self) -> tuple[int, str] | None:
        while self.at < len(self.rows) and self.rows[self.at][0] < 0:
            self.at += 1
        return self.rows[self.at] if self.at < len(self.rows) else None

    def block(self, least: int, depth: int):
        """The value that begins at the next line, if that is indented by `least` or more; else null."""
        self.node(depth)
        line = self.peek()
        if line is None or line[0] < least:
            return None
        indent, body = line
        if body == "-" or body.startswith("- "):
            return self.sequence(indent, depth)
        if _KEY.match(body):
            return self.mapping(indent, depth)
        self.at += 1
        return self.inline(body, indent, depth)

    def sequence(self, indent: int, depth: int) -> list:
        out = []
        while (line := self.peek()) and line[0] == indent and (line[1] == "-" or line[1].startswith("- ")):
            rest = line[1][1:]
            inner = rest.lstrip(" ")
            if inner and not inner.startswith("#"):
                # what follows the dash is a block of its own, indented as far as it stands
                self.rows[self.at] = (indent + 1 + len(rest) - len(inner), inner)
                out.append(self.block(indent + 1, depth + 1))
            else:
                self.at += 1
                out.append(self.block(indent + 1, depth + 1))
        line = self.peek()
        if line and line[0] > indent:
            raise SpecificationError(f"unexpected indentation: {line[1][:40]}")
        return out

    def mapping(self, indent: int, depth: int) -> dict:
        out: dict = {}
        while (line := self.peek()) and line[0] == indent:
            found = _KEY.match(line[1])
            if not found or line[1].startswith("- "):
                raise SpecificationError(f"a key was expected: {line[1][:40]}")
            key = _scalar(found[1])
            if not isinstance(key, str) or key == "<<":
                raise SpecificationError("keys must be strings, and merge keys are not allowed")
            if key in out:
                raise SpecificationError(f"repeated key {key}")
            rest = _bare(line[1][found.end() :].strip())
            self.at += 1
            if rest:
                self.node(depth + 1)
                out[key] = self.inline(rest, indent, depth + 1)
                continue
            after = self.peek()
            same = after and after[0] == indent and (after[1] == "-" or after[1].startswith("- "))
            out[key] = self.block(indent if same else indent + 1, depth + 1)
        line = self.peek()
        if line and line[0] > indent:
            raise SpecificationError(f"unexpected indentation: {line[1][:40]}")
        return out

    def inline(self, text: str, indent: int, depth: int):
        text = _bare(text)
        if re.match(r"[|>][-+]?$", text):
            return self.literal(text, indent)
        if text[0] in "[{":
            while text.count("[") + text.count("{") > text.count("]") + text.count("}") and self.peek() and self.peek()[0] > indent:
                text += " " + _bare(self.peek()[1])
                self.at += 1
            value, end = self.flow(text, 0, depth)
            if text[end:].strip():
                raise SpecificationError(f"unexpected text: {text[end:][:40]}")
            return value
        return _scalar(text)

    def literal(self, style: str, indent: int) -> str:
        lines = []
        while self.at < len(self.rows) and (self.rows[self.at][0] > indent or self.rows[self.at][0] < 0):
            depth, body = self.rows[self.at]
            lines.append((depth, body if depth >= 0 else body.strip()))
            self.at += 1
        least = min((d for d, _ in lines if d >= 0), default=0)
        texts = [" " * (d - least) + b if d >= 0 else b for d, b in lines]
        while texts and not texts[-1]:
            texts.pop()
        joined = "\n".join(texts) if style[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(texts))
        return joined if style.endswith("-") or not joined else joined + "\n"

    def flow(self, text: str, at: int, depth: int):
        self.node(depth)
        at = _skip(text, at)
        if at >= len(text):
            raise SpecificationError("an unfinished list or mapping")
        if text[at] in "[{":
            close, out_list, out_map = "]" if text[at] == "[" else "}", [], {}
            at = _skip(text, at + 1)
            while at < len(text) and text[at] != close:
                value, at = self.flow(text, at, depth + 1)
                at = _skip(text, at)
                if close == "}":
                    if at >= len(text) or text[at] != ":" or not isinstance(value, str) or value in out_map or value == "<<":
                        raise SpecificationError("a mapping needs different keys that are strings")
                    out_map[value], at = self.flow(text, at + 1, depth + 1)
                    at = _skip(text, at)
                else:
                    out_list.append(value)
                if at < len(text) and text[at] == ",":
                    at = _skip(text, at + 1)
                elif at >= len(text) or text[at] != close:
                    raise SpecificationError("an unfinished list or mapping")
            if at >= len(text):
                raise SpecificationError("an unfinished list or mapping")
            return (out_map if close == "}" else out_list), at + 1
        found = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?:[^,\[\]{}:]|:(?=\S))*)""").match(text, at)
        return _scalar(found[1].strip()), found.end()


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] == " ":
        at += 1
    return at


def _bare(text: str) -> str:
    """text without a comment at its end."""
    found = re.match(r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?<!\s)#|[^#])*?)(?:\s+#.*)?$""", text)
    return found[1].strip() if found else text


def _scalar(text: str):
    if text[:1] == '"':
        if len(text) < 2 or text[-1] != '"':
            raise SpecificationError("an unfinished string")
        try:
            return json.loads(text)
        except ValueError:
            raise SpecificationError(f"not a string: {text[:40]}") from None
    if text[:1] == "'":
        if len(text) < 2 or text[-1] != "'":
            raise SpecificationError("an unfinished string")
        return text[1:-1].replace("''", "'")
    if text[:1] in ("&", "*", "!", "%", "@", "`"):
        raise SpecificationError("anchors, aliases and tags are not allowed")
    if text in _WORDS:
        return _WORDS[text]
    if _ODD.match(text):
        raise SpecificationError("numbers must be decimal")
    if _INT.match(text):
        return int(text.replace("_", ""), 10)
    if _FLOAT.match(text):
        try:
            return _finite(float(text.replace("_", "")))
        except ValueError:
            raise SpecificationError("not a finite number") from None
    return text


def _finite(x: float) -> float:
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError
    return x


def read(text: str, max_depth: int = 32, max_nodes: int = 10_000):
    """The value of a document. Its root is a mapping."""
    lines = _Lines(text, max_depth, max_nodes)
    first = lines.peek()
    if first and first[1] == "---":
        lines.at += 1
        first = lines.peek()
    if first is None:
        raise SpecificationError("a specification cannot be empty")
    value = lines.block(0, 1)
    if lines.peek() is not None:
        raise SpecificationError(f"unexpected text: {lines.peek()[1][:40]}")
    if not isinstance(value, dict):
        raise SpecificationError("the root must be a mapping")
    return value
