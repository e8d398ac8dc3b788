"""JSON text that must be one value, without repeated keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_json(text: Column) -> Column:
    """text as a VARIANT; null if it is not one JSON value and nothing else, or if an object in it has a key twice.

    The parser refuses repeated keys at any depth but stops after the first value, so the text must also be one value
    between brackets, and one between braces: what follows the first value would have to close both."""
    item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = item.isNotNull() & F.try_variant_get(item, "$[1]", "variant").isNull()
    kept = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit("}"))).isNotNull()
    return F.when(alone & kept, F.try_parse_json(text))


def object_problem(text: Column) -> Column:
    """Why text is no object in strict JSON: JSON, or REPEATED_KEY if that is all; null if it is one."""
    keys = F.json_object_keys(text)
    parsed = strict_json(text)
    # the outer keys can be read, but the parser refuses the whole; the reader of keys takes single quotes, too
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    return F.when(keys.isNotNull() & F.try_parse_json(text).isNull() & ~bare.contains("'"), "REPEATED_KEY").when(keys.isNull() | parsed.isNull(), "JSON")
