"""Lineage of derived repositories: chains of bases, checked by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed


def lineage_problems(repositories: DataFrame) -> DataFrame:
    """(repository, problem, ancestors, cycle) of repositories (repository, base, family, split), ids once each. problem is what the
    way up from a repository meets first: CROSSING (an ancestor of another family or split), MISSING (a base that is not
    there), CYCLE, or null. ancestors counts those on the way (null if the way does not end), cycle is the
    least id of the cycle that it ends in.

    Each repository knows what holds on its next 2**k bases, and doubles that each round by one self-join, so a chain of n
    takes log2(n) rounds. A way that still goes on after as many steps as there are rows is in a cycle; the place it
    has come to is on the cycle, and as many steps from there pass all of it."""
    own = repositories.select(F.col("repository").alias("id"), "base", "family", "split")
    there = own.select(F.col("id").alias("base"), F.col("family").alias("f"), F.col("split").alias("s"), F.lit(True).alias("found"))
    same = F.col("family").eqNullSafe(F.col("f")) & F.col("split").eqNullSafe(F.col("s"))
    rows = own.join(there, "base", "left").select(
        "id", F.when(F.col("found"), F.col("base")).alias("at"), (F.col("base").isNotNull() & F.col("found").isNull()).alias("missing"), (F.col("found").isNotNull() & ~same).alias("crossed"),
        F.when(F.col("found"), 1).otherwise(0).cast("long").alias("steps"), F.col("id").alias("least"),
    )
    rows = checkpointed(rows)
    for _ in range(max(1, rows.count()).bit_length()):
        next_ = rows.select(F.col("id").alias("at"), F.col("at").alias("at_"), F.col("missing").alias("m"), F.col("crossed").alias("c"), F.col("steps").alias("n"), F.col("least").alias("l"))
        rows = checkpointed(rows.join(next_, "at", "left").select(
            "id", F.col("at_").alias("at"), (F.col("missing") | F.coalesce("m", F.lit(False))).alias("missing"), (F.col("crossed") | F.coalesce("c", F.lit(False))).alias("crossed"),
            (F.col("steps") + F.coalesce("n", F.lit(0))).alias("steps"), F.least("least", "l").alias("least"),
        ))
    round_ = rows.select(F.col("id").alias("at"), F.col("least").alias("cycle"))
    out = rows.join(round_, "at", "left")
    problem = F.when(F.col("crossed"), "CROSSING").when(F.col("missing"), "MISSING").when(F.col("at").isNotNull(), "CYCLE")
    return out.select(F.col("id").alias("repository"), problem.alias("problem"), F.when(F.col("at").isNull(), F.col("steps")).alias("ancestors"), "cycle")
