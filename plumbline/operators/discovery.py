"""Architecture discovery: signals from names, paths, annotations, imports; arbitration; modules; matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The role that a name's last words tell, by those words.
NAME_ROLES = {
    "controller": "CONTROLLER",
    "resource": "CONTROLLER",
    "handler": "CONTROLLER",
    "service": "SERVICE",
    "use case": "SERVICE",
    "repository": "REPOSITORY",
    "dao": "REPOSITORY",
    "entity": "DOMAIN_MODEL",
    "aggregate": "DOMAIN_MODEL",
    "aggregate root": "DOMAIN_MODEL",
    "domain service": "DOMAIN_SERVICE",
    "adapter": "ADAPTER",
    "gateway": "GATEWAY",
    "client": "CLIENT",
    "config": "CONFIGURATION",
    "configuration": "CONFIGURATION",
    "util": "UTILITY",
    "utils": "UTILITY",
    "helper": "UTILITY",
}
#: Role and layer that a directory tells.
PATH_SIGNALS = {
    "controller": ("CONTROLLER", "PRESENTATION"),
    "controllers": ("CONTROLLER", "PRESENTATION"),
    "handlers": ("CONTROLLER", "PRESENTATION"),
    "service": ("SERVICE", "APPLICATION"),
    "services": ("SERVICE", "APPLICATION"),
    "usecases": ("SERVICE", "APPLICATION"),
    "repository": ("REPOSITORY", "PERSISTENCE"),
    "repositories": ("REPOSITORY", "PERSISTENCE"),
    "dao": ("REPOSITORY", "PERSISTENCE"),
    "adapter": ("ADAPTER", "INFRASTRUCTURE"),
    "adapters": ("ADAPTER", "INFRASTRUCTURE"),
    "domain": (None, "DOMAIN"),
    "application": (None, "APPLICATION"),
    "persistence": (None, "PERSISTENCE"),
    "infrastructure": (None, "INFRASTRUCTURE"),
    "infra": (None, "INFRASTRUCTURE"),
    "presentation": (None, "PRESENTATION"),
    "clients": ("CLIENT", "INFRASTRUCTURE"),
    "config": ("CONFIGURATION", "INFRASTRUCTURE"),
    "utils": ("UTILITY", None),
}
#: The layer of a role.
ROLE_LAYER = {
    "CONTROLLER": "PRESENTATION",
    "SERVICE": "APPLICATION",
    "REPOSITORY": "PERSISTENCE",
    "DOMAIN_MODEL": "DOMAIN",
    "DOMAIN_SERVICE": "DOMAIN",
    "ADAPTER": "INFRASTRUCTURE",
    "GATEWAY": "INFRASTRUCTURE",
    "CLIENT": "INFRASTRUCTURE",
    "CONFIGURATION": "INFRASTRUCTURE",
}
#: The role that an annotation tells, by language and annotation.
ANNOTATION_ROLES = {
    "JAVA": {
        "RestController": "CONTROLLER",
        "Controller": "CONTROLLER",
        "Service": "SERVICE",
        "Repository": "REPOSITORY",
        "Configuration": "CONFIGURATION",
        "Entity": "DOMAIN_MODEL",
        "AggregateRoot": "DOMAIN_MODEL",
        "Component": None,
    },
    "TYPESCRIPT": {"Controller": "CONTROLLER", "Injectable": None},
    "JAVASCRIPT": {"Controller": "CONTROLLER", "Injectable": None},
}
#: Strengths: 1 weak, 2 moderate, 3 strong.
WEAK, MODERATE, STRONG = 1, 2, 3
#: Path segments that name no module of their own.
TECHNICAL = (
    "src main java com org example controller controllers service services repository repositories domain"
    " application infrastructure infra adapter adapters presentation persistence"
).split()


def lookup(key: Column, table: dict) -> Column:
    """table[key], null where there is none: a constant map, so no join."""
    pairs = [x for k, v in table.items() if v is not None for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def name_tokens(name: Column) -> Column:
    """The words of an identifier in lower case: camel case, acronyms, digits apart from a following capital, _ and -."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[ _\-]+"), lambda t: t != "")


def name_role(name: Column) -> Column:
    """The role of the longest run of last words in the table."""
    tokens = name_tokens(name)
    two, one = F.array_join(F.slice(tokens, F.greatest(F.size(tokens) - 1, F.lit(1)), 2), " "), F.array_join(F.slice(tokens, F.greatest(F.size(tokens), F.lit(1)), 1), " ")
    return F.coalesce(F.when(F.size(tokens) > 1, lookup(two, NAME_ROLES)), lookup(one, NAME_ROLES))


def path_signals(files: DataFrame, path: str = "path") -> DataFrame:
    """One row for each directory of a path that tells a role or layer: adds segment, role, layer."""
    dirs = F.split(F.lower(F.regexp_replace(F.col(path), "[^/]*$", "")), "/")
    rows = files.withColumn("segment", F.explode(F.filter(dirs, lambda s: s != "")))
    rows = rows.filter(F.col("segment").isin(*PATH_SIGNALS))
    role, layer = ({k: v[i] for k, v in PATH_SIGNALS.items()} for i in (0, 1))
    return rows.withColumns({"role": lookup(F.col("segment"), role), "layer": lookup(F.col("segment"), layer)})


def annotation_signals(rows: DataFrame) -> DataFrame:
    """rows (subject, language, annotation): role, and strength (strong with a role, else moderate) of known ones."""
    known = {f"{lang}:{a}": r or "-" for lang, table in ANNOTATION_ROLES.items() for a, r in table.items()}
    found = rows.withColumn("role", lookup(F.concat_ws(":", "language", "annotation"), known)).filter(F.col("role").isNotNull())
    found = found.withColumn("role", F.nullif("role", F.lit("-")))
    return found.withColumn("strength", F.when(F.col("role").isNull(), MODERATE).otherwise(STRONG))


def prefix_signals(imports: DataFrame, prefixes: DataFrame) -> DataFrame:
    """imports (subject, module) that are a known prefix (prefix) or lie below it. A module is exploded to its dotted
    prefixes, so this is an equi-join."""
    parts = F.split("module", r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return imports.withColumn("prefix", F.explode(ups)).join(prefixes, "prefix")


def arbitrate(evidence: DataFrame, minimum: int = MODERATE) -> DataFrame:
    """evidence (subject, role, strength, kind) -> (subject, role, strength, status). The strongest role wins; a name and a
    path that agree make it strong; a tie at the top is AMBIGUOUS; under `minimum`, or without a role, UNKNOWN."""
    per = evidence.filter(F.col("role").isNotNull()).groupBy("subject", "role").agg(
        F.max("strength").alias("s"), F.max(F.col("kind") == "NAME").alias("n"), F.max(F.col("kind") == "PATH").alias("p")
    )
    per = per.withColumn("s", F.when(F.col("n") & F.col("p"), F.greatest("s", F.lit(STRONG))).otherwise(F.col("s")))
    best = per.groupBy("subject").agg(F.max("s").alias("top"), F.collect_list(F.struct("s", "role")).alias("all"))
    leaders = F.filter("all", lambda x: x["s"] == F.col("top"))
    best = best.withColumn("_lead", leaders)
    subjects = evidence.select("subject").distinct().join(best, "subject", "left")
    tie, low = F.size("_lead") > 1, F.col("top").isNull() | (F.col("top") < minimum)
    return subjects.select(
        "subject",
        F.when(low | tie, "UNKNOWN").otherwise(F.get("_lead", F.lit(0))["role"]).alias("role"),
        F.coalesce("top", F.lit(0)).alias("strength"),
        F.when(low, "UNKNOWN").when(tie, "AMBIGUOUS").otherwise("RESOLVED").alias("status"),
    )


def layers(roles: DataFrame, hints: DataFrame) -> DataFrame:
    """roles (subject, role), hints (subject, layer): one distinct layer is taken, more are AMBIGUOUS whatever their
    strength, none is UNKNOWN."""
    own = roles.select("subject", lookup(F.col("role"), ROLE_LAYER).alias("layer"))
    rows = own.union(hints.select("subject", "layer")).groupBy("subject").agg(F.array_sort(F.collect_set("layer")).alias("c"))
    return rows.select(
        "subject",
        F.when(F.size("c") == 1, F.get("c", F.lit(0))).otherwise("UNKNOWN").alias("layer"),
        F.array_join("c", ",").alias("candidates"),
        F.when(F.size("c") == 1, "RESOLVED").when(F.size("c") > 1, "AMBIGUOUS").otherwise("UNKNOWN").alias("status"),
    )


def common_prefix(rows: DataFrame, group: str, path: str, sep: str = "/") -> DataFrame:
    """(group, prefix, depth): the longest run of leading segments that all paths of a group share."""
    parts = rows.select(group, F.posexplode(F.split(path, sep)).alias("i", "segment"))
    n = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    per = parts.groupBy(group, "i").agg(F.count_distinct("segment").alias("d"), F.count(F.lit(1)).alias("k"), F.min("segment").alias("segment"))
    same = per.join(n, group).withColumn("ok", (F.col("d") == 1) & (F.col("k") == F.col("n")))
    run = W.partitionBy(group).orderBy("i")
    same = same.withColumn("all", F.min(F.col("ok").cast("int")).over(run)).filter("all = 1")
    shared = same.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "segment"))), lambda x: x["segment"]), sep).alias("prefix"), F.count(F.lit(1)).cast("int").alias("depth"))
    return n.select(group).join(shared, group, "left").na.fill({"prefix": "", "depth": 0})


def module_seeds(files: DataFrame, min_members: int = 2, depth: int = 0) -> DataFrame:
    """(module, members): files by their first directory that is not technical, at least min_members."""
    dirs = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    own = F.get(F.filter(dirs, lambda s: ~F.lower(s).isin(*TECHNICAL) & (s != "")), F.lit(depth))
    rows = files.select(own.alias("module")).filter(F.col("module").isNotNull())
    return rows.groupBy("module").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= min_members)


def labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges with src_label and dst_label from labels (v, label)."""
    a = labels.select(F.col("v").alias("src"), F.col("label").alias("src_label"))
    b = labels.select(F.col("v").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(a, "src", "left").join(b, "dst", "left")


def cohesion(edges: DataFrame, labels: DataFrame, min_members: int = 2) -> DataFrame:
    """(label, members, internal, outgoing, incoming, ratio, strength): internal edges by all that touch the label."""
    rows = labelled(edges, labels).filter("src_label is not null or dst_label is not null")
    same = F.col("src_label").eqNullSafe(F.col("dst_label"))
    sides = F.array(
        F.struct(F.col("src_label").alias("label"), same.cast("int").alias("internal"), (~same).cast("int").alias("outgoing"), F.lit(0).alias("incoming")),
        F.struct(F.when(~same, F.col("dst_label")).alias("label"), F.lit(0).alias("internal"), F.lit(0).alias("outgoing"), F.lit(1).alias("incoming")),
    )
    per = rows.select(F.explode(sides).alias("x")).select("x.*").filter("label is not null").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("internal", "outgoing", "incoming")])
    members = labels.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    out = members.join(per, "label", "left").na.fill(0)
    total = F.col("internal") + F.col("outgoing") + F.col("incoming")
    strong = (F.col("members") >= min_members) & (F.col("internal") > F.col("outgoing") + F.col("incoming"))
    return out.withColumns({"ratio": F.try_divide(F.col("internal").cast("double"), total.cast("double")), "strength": F.when(strong, "STRONG").otherwise("MODERATE")})


def matrix(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The sparse dependency matrix (src_label, dst_label, edges), without edges that lack a label."""
    rows = labelled(edges, labels).filter("src_label is not null and dst_label is not null")
    return rows.groupBy("src_label", "dst_label").agg(F.count(F.lit(1)).alias("edges"))


def top_k(rows: DataFrame, metric: str, key: str, k: int = 5) -> DataFrame:
    """The k rows of the largest metric, nulls dropped, ties by key, with their rank. A sort and limit, not a window
    over everything: each task keeps k rows."""
    best = rows.filter(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col(metric).desc(), key)))


def layer_groups(subjects: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """subjects (v, label, strength) -> one row for each name (label), used or not: members, weak, moderate, strong, and
    internal, outgoing, incoming edges."""
    per = subjects.groupBy("label").agg(F.count(F.lit(1)).alias("members"), *[F.count_if(F.col("strength") == s).alias(n) for n, s in (("weak", WEAK), ("moderate", MODERATE), ("strong", STRONG))])
    links = cohesion(edges, subjects.select("v", "label"), 0).select("label", "internal", "outgoing", "incoming")
    return names.select("label").join(per, "label", "left").join(links, "label", "left").na.fill(0)


def coverage(rows: DataFrame) -> DataFrame:
    """rows (subject, role, layer): how many have a role and a layer, and the shares."""
    known = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c) != "UNKNOWN"))
    out = rows.agg(F.count(F.lit(1)).alias("subjects"), known("role").alias("with_role"), known("layer").alias("with_layer"))
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("subjects").cast("double"))
    return out.withColumns({"role_coverage": share("with_role"), "layer_coverage": share("with_layer")})


def direction_evidence(edges: DataFrame, layers_: DataFrame, order: dict[str, int]) -> DataFrame:
    """(subject, evidence): weak evidence that a subject depends on a lower layer; it never changes a label."""
    rows = labelled(edges, layers_)
    rank = lambda c: lookup(F.col(c), {k: str(v) for k, v in order.items()}).cast("int")
    down = rows.filter(rank("src_label") < rank("dst_label"))
    return down.groupBy(F.col("src").alias("subject")).agg(F.array_join(F.array_sort(F.collect_set("dst_label")), ",").alias("evidence"))
