"""Nested evidence packs with fingerprints that roll up from items to packs, whatever the order of either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed

LANES = 8


def _lanes(digest: Column) -> list[Column]:
    """The 32-bit parts of a digest in hexadecimal, as numbers."""
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(28,0)").alias(f"_l{i}") for i in range(LANES)]


def _sums(*more: Column) -> list[Column]:
    return [*[F.sum(f"_l{i}").cast("decimal(28,0)").alias(f"_l{i}") for i in range(LANES)], *more]


def levels(parts: DataFrame) -> DataFrame:
    """parts (pack, parent) with level: 0 for a pack without parent, else one more than the parent's. Packs that no root reaches
    (in a ring, or below a pack that is not there) have a null level. Takes a round a level."""
    parts = parts.select("pack", "parent").distinct()
    front = checkpointed(parts.filter("parent is null").withColumn("level", F.lit(0)))
    found, depth = front, 0
    while not front.isEmpty():
        depth += 1
        above = front.select(F.col("pack").alias("parent"))
        front = checkpointed(parts.join(above, "parent").select("pack", "parent", F.lit(depth).alias("level")))
        found = found.unionByName(front)
    return parts.join(found.select("pack", "level"), "pack", "left")


def fingerprints(items: DataFrame, parts: DataFrame) -> DataFrame:
    """(pack, parent, level, items, children, below, fingerprint). items: (pack, content string), repeats counted; parts: (pack, parent),
    each pack once, the parent of a root null.

    The digests of a pack's items and of its packs are added up in 32-bit parts, and the sums and counts hashed: equal content
    gives equal fingerprints in any order and under any name, a change alters the packs above it only, and as sums combine on
    the map side, a pack may hold any share of all rows. A null content counts as an item of its own kind. `below` is how many items the
    pack and those in it hold. Packs that no root reaches have null level and fingerprint. One shuffle a level of nesting."""
    tree = checkpointed(levels(parts))
    deepest = tree.agg(F.max("level")).first()[0]
    digest = F.sha2(F.coalesce(F.concat(F.lit("item:"), "content"), F.lit("none")), 256)
    own = items.select("pack", *_lanes(digest)).groupBy("pack").agg(*_sums(F.count(F.lit(1)).alias("_items")))
    own = checkpointed(own.select("*", F.lit(0).cast("long").alias("_children"), F.col("_items").alias("_below")))
    zero = {"_items": 0, "_children": 0, "_below": 0, **{f"_l{i}": 0 for i in range(LANES)}}
    out, up = tree.filter("level is null").select("pack", "parent", "level", *[F.lit(None).cast("long").alias(c) for c in ("items", "children", "below")], F.lit(None).cast("string").alias("fingerprint")), None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        held = own
        if up is not None:
            held = own.unionByName(up).groupBy("pack").agg(*_sums(*[F.sum(c).alias(c) for c in ("_items", "_children", "_below")]))
        here = tree.filter(F.col("level") == level).join(held, "pack", "left").na.fill(0, ["_items", "_children", "_below"])
        here = here.withColumns({c: F.coalesce(c, F.lit(0).cast("decimal(28,0)")) for c in zero if c.startswith("_l")})
        text = F.concat_ws("|", "_items", "_children", *[F.col(f"_l{i}").cast("string") for i in range(LANES)])
        here = here.select("pack", "parent", "level", F.col("_items").alias("items"), F.col("_children").alias("children"), F.col("_below").alias("below"), F.sha2(text, 256).alias("fingerprint"))
        here = checkpointed(here)
        rows = here.filter("parent is not null").select(F.col("parent").alias("pack"), *_lanes(F.sha2(F.concat(F.lit("pack:"), "fingerprint"), 256)), "below")
        up = rows.groupBy("pack").agg(*_sums(F.lit(0).cast("long").alias("_items"), F.count(F.lit(1)).alias("_children"), F.sum("below").alias("_below")))
        out = out.unionByName(here)
    return out


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pack, status) of two results of fingerprints(): ADDED, REMOVED, CHANGED or SAME; packs without a fingerprint on both sides are
    SAME."""
    a = before.select("pack", F.col("fingerprint").alias("_a"), F.lit(True).alias("_was"))
    b = after.select("pack", F.col("fingerprint").alias("_b"), F.lit(True).alias("_is"))
    status = F.when(F.col("_was").isNull(), "ADDED").when(F.col("_is").isNull(), "REMOVED").when(F.col("_a").eqNullSafe(F.col("_b")), "SAME").otherwise("CHANGED")
    return a.join(b, "pack", "full").select("pack", status.alias("status"))
