"""Path globs as anchored regular expressions, so that a scope is a plain rlike filter."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment_regex(segment: str) -> str:
    """One path segment: * and ? stay within it, [..] is a character class, the rest is literal."""
    out, i = "", 0
    while i < len(segment):
        c = segment[i]
        close = segment.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif close > 0:
            body = segment[i + 1 : close].replace("\\", "\\\\")
            out += f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_regex(glob: str) -> str:
    """`**` as a whole segment is any number of segments, none included."""
    out, parts = "^", glob.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last and i == 0 else ("(?:/.*)?" if last else "(?:[^/]+/)*")
            continue
        out += segment_regex(part)
        if not last and not (parts[i + 1] == "**" and i + 1 == len(parts) - 1):
            out += "/"
    return out + "$"


def matches(path: Column, globs: Sequence[str]) -> Column:
    out = F.lit(False)
    for glob in globs:
        out = out | path.rlike(glob_regex(glob))
    return out


def in_scope(path: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """True if any include matches and no exclude does."""
    return matches(path, include) & ~matches(path, exclude)
