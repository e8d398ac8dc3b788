"""Data set manifests in JSON, many at once: strict parsing into VARIANT, limits and rules as columns, one problem code a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.strict import object_problem, strict_json

#: Bytes, depth and repositories that a manifest may have.
MAX_BYTES, MAX_DEPTH, MAX_REPOSITORIES = 2_097_152, 32, 500
#: The splits of a data set.
SPLITS = ("TRAIN", "DEV", "TEST")


def nesting(text: Column) -> Column:
    """How deep objects and arrays are nested in JSON text; strings do not count."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    begin = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state, mark):
        now = state["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(F.split(marks, ""), begin, step, lambda state: state["most"])


def unsafe_path(path: Column) -> Column:
    """True for what is no canonical relative path."""
    part = F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    return F.coalesce(path.startswith("/") | path.contains("\\") | path.contains(":") | part, F.lit(True))


def load_manifests(manifests: DataFrame, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH, max_repositories: int = MAX_REPOSITORIES) -> tuple[DataFrame, DataFrame]:
    """(repositories, problems) of manifests (manifest, text), objects with an array `repositories` of objects.

    repositories (manifest, place, repository, base, family, split, path) of the manifests that have no problem;
    problems (manifest, place, code), place null for the manifest itself: SIZE, JSON, REPEATED_KEY, DEPTH, SHAPE (no such array),
    REPOSITORIES (too many), and for a repository FIELD (a name is missing or no string), SPLIT, PATH, REPEATED_REPOSITORY.
    A manifest that fails as a whole is not looked into further. A null text is JSON."""
    text = F.col("text")
    whole = F.when(F.octet_length(text) > max_bytes, "SIZE").otherwise(F.coalesce(object_problem(F.coalesce(text, F.lit(""))), F.when(nesting(text) > max_depth, "DEPTH")))
    rows = manifests.select("manifest", "text", whole.alias("code"))
    given = F.try_variant_get(F.when(F.col("code").isNull(), strict_json(text)), "$.repositories", "array<variant>")
    rows = rows.select("manifest", "code", given.alias("given"))
    shape = F.when(F.col("given").isNull(), "SHAPE").when(F.size("given") > max_repositories, "REPOSITORIES")
    rows = rows.select("manifest", "given", F.coalesce("code", shape).alias("code"))
    read = lambda name: F.try_variant_get("item", f"$.{name}", "string")
    items = rows.filter("code IS NULL").select("manifest", F.posexplode("given").alias("place", "item"))
    names = ("repository", "family", "split", "path")
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get("item", f"$.{name}", "variant")), F.lit("VOID"))
    items = items.select("manifest", "place", *[read(n).alias(n) for n in (*names, "base")], F.forall(F.array(*[kind(n) for n in names]), lambda k: k == "STRING").alias("told"))
    twice = items.filter("repository IS NOT NULL").groupBy("manifest", "repository").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    items = items.join(twice, ["manifest", "repository"], "left")
    codes = F.array_compact(F.array(
        F.when(~F.col("told"), "FIELD"), F.when(F.col("told") & ~F.col("split").isin(*SPLITS), "SPLIT"), F.when(F.col("told") & unsafe_path(F.col("path")), "PATH"), F.when(F.col("times") > 1, "REPEATED_REPOSITORY")
    ))
    items = items.withColumn("codes", codes)
    wrong = items.select("manifest", "place", F.explode("codes").alias("code"))
    problems = rows.filter("code IS NOT NULL").select("manifest", F.lit(None).cast("int").alias("place"), "code").union(wrong)
    good = items.join(wrong.select("manifest").distinct(), "manifest", "left_anti")
    return good.select("manifest", "place", "repository", "base", "family", "split", "path"), problems
