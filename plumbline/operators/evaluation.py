"""Evaluation algebra: predictions against truth, agreement, splits, comparisons, costs.

There are three meanings of a false negative, and three functions: scored() and confusion() for rule findings,
unified_metrics() where every undecided positive counts as missed, semantic and security metrics where only a
definite negative does.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ranks import quantiles, with_rank


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


# -- predictions and truth ----------------------------------------------------------------------------------------


def dedupe_predictions(predictions: DataFrame, key: Sequence[str], id_column: str = "prediction_id") -> DataFrame:
    """One row for each key, with the smallest id and the number of duplicates."""
    return predictions.groupBy(*key).agg(F.min(id_column).alias(id_column), (F.count(F.lit(1)) - 1).alias("duplicates"))


def scored(truth: DataFrame, predictions: DataFrame, key: Sequence[str], closed_world: bool) -> DataFrame:
    """truth (key, label) against predictions (key, state): adds outcome: tp fp fn tn, abstain (several states, or one
    that abstains), no_prediction (an open world without a prediction), unscored (unknown truth) and extra (a
    positive prediction without truth). CANDIDATE counts as POSITIVE; a closed world reads silence as NEGATIVE."""
    state = F.when(F.col("state") == "CANDIDATE", "POSITIVE").otherwise(F.col("state"))
    own = predictions.withColumn("state", state).groupBy(*key).agg(F.array_sort(F.collect_set("state")).alias("states"))
    rows = truth.join(own, list(key), "full")
    n = F.coalesce(F.size("states"), F.lit(0))
    only = F.get("states", F.lit(0))
    said = F.when(n > 1, "ABSTAIN").when(n == 1, only).otherwise("NEGATIVE" if closed_world else "NONE")
    rows = rows.withColumn("said", said)
    yes = F.col("label") == "POSITIVE"
    outcome = (
        F.when(F.col("label").isNull(), F.when(F.col("said") == "POSITIVE", "extra").otherwise("ignored"))
        .when(F.col("label") == "UNKNOWN", "unscored")
        .when(F.col("said") == "NONE", "no_prediction")
        .when(F.col("said") == "ABSTAIN", "abstain")
        .when(F.col("said") == "POSITIVE", F.when(yes, "tp").otherwise("fp"))
        .otherwise(F.when(yes, "fn").otherwise("tn"))
    )
    return rows.withColumn("outcome", outcome).drop("states", "said")


OUTCOMES = ("tp", "fp", "fn", "tn", "abstain", "no_prediction", "extra")


def confusion(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts of outcomes and metrics by each dimension alone and in total: one grouping-sets aggregation. An extra
    counts as a false positive, and makes the false-positive rate undefined."""
    n = len(dimensions)
    sums = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    per = rows.groupingSets([*[[d] for d in dimensions], []], *dimensions).agg(*sums, F.grouping_id().alias("_g"))
    name, value = F.lit("total"), F.lit("*")
    for i, d in enumerate(dimensions):
        here = F.col("_g") == (2**n - 1) - 2 ** (n - 1 - i)
        name, value = F.when(here, d).otherwise(name), F.when(here, F.col(d).cast("string")).otherwise(value)
    per = per.withColumns({"dimension": name, "value": value, "fp": F.col("fp") + F.col("extra")})
    return with_metrics(per).drop("_g", *dimensions)


def with_metrics(rows: DataFrame) -> DataFrame:
    """Null-safe metrics over tp fp fn tn abstain no_prediction extra. F1 is null if precision or recall is."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    fpr = F.when(F.col("extra") == 0, ratio(fp, fp + tn))
    answered = tp + fp + fn + tn - F.col("extra")
    every = answered + F.col("abstain") + F.col("no_prediction")
    return rows.withColumns(
        {
            "precision": p,
            "recall": r,
            "f1": F.when(p.isNotNull() & r.isNotNull(), F.try_divide(2 * p * r, p + r)),
            "fpr": fpr,
            "fnr": ratio(fn, fn + tp),
            "abstention": ratio(F.col("abstain"), every),
            "coverage": ratio(answered, every),
        }
    )


def macro(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Means over the groups where a metric is defined."""
    return rows.agg(*[F.avg(m).alias(f"macro_{m}") for m in metrics])


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def unified_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rows (truth, decision): a positive that is not SUPPORTED counts as missed, whatever else it is."""
    yes, no = F.col("truth") == "POSITIVE", F.col("truth") == "NEGATIVE"
    supported, rejected = F.col("decision") == "SUPPORTED", F.col("decision") == "NOT_SUPPORTED"
    c = {"tp": yes & supported, "fp": no & supported, "fn": yes & ~supported, "tn": no & rejected, "definitive": (yes | no) & (supported | rejected), "cases": yes | no}
    out = rows.groupBy(*by).agg(*[F.count_if(v).alias(k) for k, v in c.items()])
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return out.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": _f1(tp, fp, fn),
            "effective_correctness": ratio(tp + tn, F.col("cases")),
            "coverage": ratio(F.col("definitive"), F.col("cases")),
        }
    )


def definite_metrics(rows: DataFrame, by: Sequence[str], negative: str) -> DataFrame:
    """Like unified_metrics, but only the decision `negative` makes a false negative; effective recall counts all."""
    yes, no = F.col("truth") == "POSITIVE", F.col("truth") == "NEGATIVE"
    supported, rejected = F.col("decision") == "SUPPORTED", F.col("decision") == negative
    c = {"tp": yes & supported, "fp": no & supported, "fn": yes & rejected, "tn": no & rejected, "open": (yes | no) & ~supported & ~rejected, "positives": yes}
    out = rows.groupBy(*by).agg(*[F.count_if(v).alias(k) for k, v in c.items()])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": _f1(tp, fp, fn), "effective_recall": ratio(tp, F.col("positives"))})


def crosstab(rows: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    return rows.groupBy(a).agg(*[F.count_if(F.col(b) == v).alias(v.lower()) for v in values])


def security_outcome(failed: Column, found: Column, potential: Column, insufficient: Column, applicable: Column, partial: Column) -> Column:
    """The outcome of an analysis of one case, by precedence."""
    return (
        F.when(failed, "FAILED")
        .when(found, "POSITIVE")
        .when(potential, "POTENTIAL")
        .when(insufficient, "INSUFFICIENT")
        .when(~applicable, "NOT_APPLICABLE")
        .when(partial, "PARTIAL")
        .otherwise("DEFINITIVE_NEGATIVE")
    )


def paired(rows: DataFrame, first: str, second: str) -> DataFrame:
    """rows (case, method, correct boolean): both, only first, only second, neither; difference in percentage points."""
    per = rows.groupBy("case_id").agg(F.max(F.when(F.col("method") == first, F.col("correct"))).alias("a"), F.max(F.when(F.col("method") == second, F.col("correct"))).alias("b"))
    per = per.filter("a is not null and b is not null")
    out = per.agg(F.count_if(F.expr("a and b")).alias("both"), F.count_if(F.expr("a and not b")).alias("first"), F.count_if(F.expr("not a and b")).alias("second"), F.count_if(F.expr("not a and not b")).alias("neither"))
    n = F.col("both") + F.col("first") + F.col("second") + F.col("neither")
    return out.withColumn("delta_points", F.try_divide(100.0 * (F.col("first") - F.col("second")), n.cast("double")))


# -- agreement ------------------------------------------------------------------------------------------------


def kappa(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa of two label columns, of exact counts: (n * agree - chance) / (n^2 - chance) where chance is the sum of
    products of marginals; null if chance agreement is certain."""
    rows = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    sides = rows.withColumn("_s", F.explode(F.array(F.struct(F.col(a).cast("string").alias("l"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col(b).cast("string").alias("l"), F.lit(0).alias("x"), F.lit(1).alias("y")))))
    margins = sides.groupBy(*by, "_s.l").agg(F.sum("_s.x").alias("x"), F.sum("_s.y").alias("y"))
    chance = margins.groupBy(*by).agg(F.sum(F.col("x") * F.col("y")).alias("chance"))
    agree = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("agree"))
    out = agree.join(chance, list(by)) if by else agree.join(F.broadcast(chance), F.lit(True))
    n = F.col("n")
    return out.withColumns({"observed": ratio(F.col("agree"), n), "expected": ratio(F.col("chance"), n * n), "kappa": ratio(n * F.col("agree") - F.col("chance"), n * n - F.col("chance"))}).drop("chance")


def reviewer_pairs(reviews: DataFrame) -> DataFrame:
    """reviews (case_id, reviewer, label) -> (case_id, raters, a, b) for cases with exactly two reviewers, in name order."""
    per = reviews.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("reviewer", "label"))).alias("r")).filter(F.size("r") == 2)
    return per.select("case_id", F.concat_ws("/", F.col("r")[0]["reviewer"], F.col("r")[1]["reviewer"]).alias("raters"), F.col("r")[0]["label"].alias("a"), F.col("r")[1]["label"].alias("b"))


def reconcile(a: Column, b: Column, adjudicated: Column) -> Column:
    """Agreement gives the label; a conflict takes the adjudicated one, or is PENDING."""
    return F.when(a == b, a).otherwise(F.coalesce(adjudicated, F.lit("PENDING")))


def replay(events: DataFrame, key: Sequence[str], seq: str, columns: Sequence[str]) -> DataFrame:
    """The latest event of each key: an append-only store folded to its state."""
    last = F.max_by(F.struct(*columns), F.col(seq)).alias("s")
    return events.groupBy(*key).agg(last).select(*key, "s.*")


# -- splits and samples ------------------------------------------------------------------------------------------


def hash_split(families: DataFrame, seed: str, column: str = "family") -> DataFrame:
    """(family, split): families by the digest of seed and name; the first n // 5 (at least one) TEST, as many more
    VALIDATION, the rest TRAIN. One row a family, so the global order is over families, not rows."""
    own = families.select(column).distinct().withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(column)), 256))
    n = own.agg(F.count(F.lit(1)).alias("_n"))
    ranked = with_rank(own, [F.col("_h"), F.col(column)], "_r").join(F.broadcast(n), F.lit(True))
    k = F.greatest(F.floor(F.col("_n") / 5), F.lit(1))
    return ranked.select(column, F.when(F.col("_r") <= k, "TEST").when(F.col("_r") <= 2 * k, "VALIDATION").otherwise("TRAIN").alias("split"))


def grouped_split(rows: DataFrame, group: str, attributes: Sequence[str], seed: str, share: float = 0.75) -> DataFrame:
    """(group, split): groups with the same set of attribute values form a bucket; in each bucket the first
    max(1, min(n - 1, floor(share * n))) by digest are TRAIN; a bucket of one is TRAIN."""
    mark = F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", *attributes))), ","), 256).alias("bucket")
    own = rows.groupBy(group).agg(mark).withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256))
    w = W.partitionBy("bucket")
    ranked = own.withColumns({"_r": F.row_number().over(w.orderBy("_h", group)), "_n": F.count(F.lit(1)).over(w)})
    k = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(F.col("_n") * share)))
    return ranked.select(group, F.when((F.col("_n") == 1) | (F.col("_r") <= k), "TRAIN").otherwise("TEST").alias("split"))


def leakage(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(key, splits): keys that occur in more than one split."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count_distinct(split).alias("n")).filter("n > 1").drop("n")


def stratified_sample(rows: DataFrame, metric: str, digest: Column, k: int) -> DataFrame:
    """rows with stratum and pick for the k chosen: terciles floor(3 (r - 1) / n) of the order by metric, then in turn LOW,
    MEDIUM, HIGH, each by digest."""
    own = rows.withColumn("_d", digest)
    n = own.agg(F.count(F.lit(1)).alias("_n"))
    own = with_rank(own, [F.col(metric), F.col("_d")], "_r").join(F.broadcast(n), F.lit(True))
    own = own.withColumn("_t", F.floor(3 * (F.col("_r") - 1) / F.col("_n")).cast("int"))
    own = own.withColumn("_i", F.row_number().over(W.partitionBy("_t").orderBy("_d"))).filter(F.col("_i") <= k)  # a group limit
    best = own.orderBy("_i", "_t").limit(k).withColumn("pick", F.row_number().over(W.orderBy("_i", "_t")))
    return best.withColumn("stratum", F.element_at(F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH")]), F.col("_t") + 1)).drop("_d", "_n", "_r", "_t", "_i")


# -- numbers ------------------------------------------------------------------------------------------------------


def describe(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, sum, mean, median, nearest-rank p95, max."""
    v = F.col(value)
    sums = rows.filter(v.isNotNull()).groupBy(*by).agg(F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("max"))
    sums = sums.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], "total", "mean", "max")
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    return quantiles(rows, value, by).join(sums, same).select(*by, "n", "total", "mean", "median", "p95", "max")


def tiered_cost(tokens: Column, cutoff: int, short_price: str, long_price: str) -> Column:
    """Exact cost of tokens at a price per million that depends on the length; prices have up to six places."""
    each = lambda price: F.lit(Decimal(price) / 1_000_000).cast("decimal(18,12)")
    return tokens.cast("decimal(18,0)") * F.when(tokens > cutoff, each(long_price)).otherwise(each(short_price))


def fused(states: Column) -> Column:
    """Any SUPPORTED, else any NOT_SUPPORTED, else all NOT_APPLICABLE, else INSUFFICIENT."""
    return (
        F.when(F.array_contains(states, "SUPPORTED"), "SUPPORTED")
        .when(F.array_contains(states, "NOT_SUPPORTED"), "NOT_SUPPORTED")
        .when((F.size(states) > 0) & F.forall(states, lambda s: s == "NOT_APPLICABLE"), "NOT_APPLICABLE")
        .otherwise("INSUFFICIENT")
    )


def edge_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, dst, change): edges ADDED and REMOVED."""
    a, b = before.select("src", "dst").distinct(), after.select("src", "dst").distinct()
    return b.exceptAll(a).withColumn("change", F.lit("ADDED")).union(a.exceptAll(b).withColumn("change", F.lit("REMOVED")))


def intent_diagnostic(rows: DataFrame, pair: str) -> DataFrame:
    """rows (pair, role CONTROL or MUTATION, confirmed boolean) -> (pair, diagnosis)."""
    per = rows.groupBy(pair).agg(*[F.max(F.when(F.col("role") == r, F.col("confirmed"))).alias(r.lower()) for r in ("CONTROL", "MUTATION")])
    c, m = F.coalesce("control", F.lit(False)), F.coalesce("mutation", F.lit(False))
    return per.select(pair, F.when(c & m, "FULLY_CONFIRMED").when(m, "CONTROL_NOT_CONFIRMED").when(c, "MUTATION_NOT_CONFIRMED").otherwise("BOTH_NOT_CONFIRMED").alias("diagnosis"))


def scoped_extras(positives: DataFrame, rule_scopes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Unmatched positive predictions (prediction_id, rule_id, paths array) with scope: scoped_extra_fp if their rule is fully
    annotated (rule_scopes: rule_id) or every path lies under an annotated prefix (prefixes: prefix), else out_of_scope.
    Paths are exploded to their prefixes, so the prefix test is an equi-join."""
    whole = positives.join(rule_scopes.select("rule_id").distinct().withColumn("_whole", F.lit(True)), "rule_id", "left")
    each = positives.select("prediction_id", F.posexplode("paths").alias("i", "path"))
    parts = F.split("path", "/")
    ups = each.select("prediction_id", "i", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("prefix"))
    under = ups.join(prefixes.select("prefix").distinct(), "prefix", "left_semi").groupBy("prediction_id").agg(F.count_distinct("i").alias("_n"))
    out = whole.join(under, "prediction_id", "left")
    inside = F.coalesce("_whole", F.lit(False)) | ((F.size("paths") > 0) & (F.col("_n") == F.size("paths")))
    return out.withColumn("scope", F.when(F.coalesce(inside, F.lit(False)), "scoped_extra_fp").otherwise("out_of_scope")).drop("_whole", "_n")


def review_violations(events: DataFrame) -> DataFrame:
    """events (case_id, reviewer, seq, role REVIEWER or ADJUDICATOR, supersedes) -> (case_id, problem): more than two
    reviewers, an adjudicator who reviewed, an amendment that does not name the event it replaces."""
    last = F.lag("seq").over(W.partitionBy("case_id", "reviewer", "role").orderBy("seq"))
    wrong = events.withColumn("_last", last).filter(~F.col("supersedes").eqNullSafe(F.col("_last"))).select("case_id", F.lit("supersedes").alias("problem"))
    per = events.groupBy("case_id").agg(
        F.collect_set(F.when(F.col("role") == "REVIEWER", F.col("reviewer"))).alias("r"), F.collect_set(F.when(F.col("role") == "ADJUDICATOR", F.col("reviewer"))).alias("a")
    )
    many = per.filter(F.size("r") > 2).select("case_id", F.lit("reviewers"))
    both = per.filter(F.arrays_overlap("r", "a")).select("case_id", F.lit("adjudicator"))
    return wrong.union(many).union(both).distinct()


def training_rows(anchors: DataFrame, truth: DataFrame) -> DataFrame:
    """anchors (anchor_id, case_id, features_complete) joined to truth (case_id, label, split): eligible, and why not."""
    rows = anchors.join(truth, "case_id", "left")
    why = F.array_compact(
        F.array(
            F.when(F.col("label").isNull(), "NO_TRUTH"),
            F.when(F.col("label") == "UNKNOWN", "UNKNOWN_LABEL"),
            F.when(F.col("split") == "TEST", "HELD_OUT"),
            F.when(~F.col("features_complete"), "FEATURES_MISSING"),
        )
    )
    return rows.withColumns({"reasons": F.array_join(why, ","), "eligible": F.size(why) == 0})


def readiness(rows: DataFrame, minimum: int) -> DataFrame:
    """rows (rule_id, split, label) -> counts of each rule and split, and what is missing for a fit."""
    out = rows.groupBy("rule_id", "split").agg(F.count_if(F.col("label") == "POSITIVE").alias("positives"), F.count_if(F.col("label") == "NEGATIVE").alias("negatives"))
    why = F.array_compact(F.array(F.when(F.col("positives") < minimum, "FEW_POSITIVES"), F.when(F.col("negatives") < minimum, "FEW_NEGATIVES")))
    return out.withColumn("reasons", F.array_join(why, ","))


#: Ablations: which channels each variant may use.
ABLATIONS = {"A1": ("static",), "A2": ("graph",), "A3": ("semantic",), "A4": ("static", "graph"), "A5": ("static", "semantic"), "A6": ("graph", "semantic"), "A7": ("static", "graph", "semantic")}


def ablated(rows: DataFrame, channels: Sequence[str] = ("static", "graph", "semantic")) -> DataFrame:
    """rows (case_id, truth, and a state column for each channel) -> one row a case and variant with the first decided state
    of its channels in list order. Variants are an array that is exploded, not a join."""
    variants = []
    for name, used in ABLATIONS.items():
        state = F.coalesce(*[F.when(F.col(c).isin("SUPPORTED", "NOT_SUPPORTED"), F.col(c)) for c in channels if c in used], F.lit("INSUFFICIENT"))
        variants.append(F.struct(F.lit(name).alias("variant"), state.alias("decision")))
    return rows.select("case_id", "truth", F.explode(F.array(*variants)).alias("v")).select("case_id", "truth", "v.variant", "v.decision")
