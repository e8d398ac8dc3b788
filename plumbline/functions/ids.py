"""Content-derived identities: name-based UUIDs, canonical keys and order-free fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uuid5(namespace: str | Column, name: Column) -> Column:
    """The version-5 UUID of a name in a namespace UUID, as lower-case text."""
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    raw = F.sha1(F.concat(F.unhex(F.replace(space, F.lit("-"), F.lit(""))), name.cast("binary")))
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), F.conv(F.substring(raw, 17, 1), 16, 10).cast("int") % 4 + 1)
    parts = [F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3))]
    parts += [F.concat(variant, F.substring(raw, 18, 3)), F.substring(raw, 21, 12)]
    return F.concat_ws("-", *parts)


def canonical_key(*parts: Column) -> Column:
    """A key that keeps parts apart: a JSON array of strings, null as null."""
    return F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"})


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (fingerprint, rows): SHA-256 over the rows as JSON lines in sorted order, whatever their order here.

    Lines are hashed on the executors first, so what meets in one place is 64 characters a row."""
    line = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    hashed = df.select(line.alias("h"))
    part = hashed.groupBy(F.substring("h", 1, 3).alias("p")).agg(
        F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("h"))), 256).alias("d"), F.count(F.lit(1)).alias("n")
    )
    lines = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: F.concat(x["p"], x["d"])))
    return part.agg(F.sha2(lines, 256).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
