"""Calibration: weights, preprocessing, ridge and logistic fits, thresholds, model selection.

Fits aggregate X'WX-like sums on the executors and solve a system of a few unknowns on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed
from .ranks import quantiles, with_rank


def family_weights(rows: DataFrame, family: str = "family") -> DataFrame:
    """rows with weight N / (F * n_f). Family sizes join back, so a large family is no single task."""
    size = rows.groupBy(family).agg(F.count(F.lit(1)).alias("_nf"))
    total = size.agg(F.sum("_nf").alias("_n"), F.count(F.lit(1)).alias("_f"))
    both = size.join(F.broadcast(total), F.lit(True)).select(F.col(family).alias("_fam"), (F.col("_n") / (F.col("_f") * F.col("_nf"))).alias("weight"))
    return rows.join(both, F.col(family).eqNullSafe(F.col("_fam"))).drop("_fam")


def fit_preprocessor(rows: DataFrame, features: Sequence[str], every: bool = False) -> DataFrame:
    """(feature, median, mean, scale, has_missing) after median imputation with population deviation; features that are
    all missing or constant are left out, unless `every` is set. has_missing of no rows is null."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f).isNull()).alias(f"k_{f}") for f in features]).first().asDict()
    facts |= {f"m_{f}": (quantiles(rows, f).first() or {"median": None})["median"] for f in features}
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(facts[f"m_{f}"])) for f in features]
    stats = rows.agg(*[x for f, v in zip(features, filled, strict=True) for x in (F.avg(v).alias(f"a_{f}"), F.stddev_pop(v).alias(f"s_{f}"))]).first()
    out = [(f, facts[f"m_{f}"], stats[f"a_{f}"], stats[f"s_{f}"], facts[f"k_{f}"] > 0 if facts["n"] else None) for f in features if every or facts[f"m_{f}"] is not None and stats[f"s_{f}"]]
    return rows.sparkSession.createDataFrame(out, "feature string, median double, mean double, scale double, has_missing boolean")


def _moments(rows: DataFrame, columns: Sequence[Column], weight: Column, target: Column) -> tuple[np.ndarray, np.ndarray]:
    k = len(columns)
    sums = [F.sum(weight * columns[i] * columns[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(weight * columns[i] * target).alias(f"b{i}") for i in range(k)]
    got = rows.agg(*sums).first()
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = got[f"a{i}_{j}"] or 0.0
    return a, np.array([got[f"b{i}"] or 0.0 for i in range(k)])


def ridge(rows: DataFrame, features: Sequence[str], target: str, weight: Column | None = None, l2: float = 1.0) -> np.ndarray:
    """Coefficients, then the intercept, which is not penalised."""
    columns = [*[F.col(f).cast("double") for f in features], F.lit(1.0)]
    a, b = _moments(rows, columns, F.lit(1.0) if weight is None else weight, F.col(target).cast("double"))
    return np.linalg.solve(a + l2 * np.diag([1.0] * len(features) + [0.0]), b)


def logistic(rows: DataFrame, features: Sequence[str], target: str, weight: Column | None = None, c: float = 1.0, tolerance: float = 1e-10, rounds: int = 200) -> np.ndarray:
    """Weighted logistic regression by Newton's method with halving line search; l2 = 1 / c on all but the intercept."""
    w = F.lit(1.0) if weight is None else weight
    x, y = [*[F.col(f).cast("double") for f in features], F.lit(1.0)], F.col(target).cast("double")
    penalty = np.diag([1.0 / c] * len(features) + [0.0])
    beta = np.zeros(len(x))

    def z(b: np.ndarray) -> Column:
        return sum((col * float(v) for col, v in zip(x[1:], b[1:], strict=True)), x[0] * float(b[0]))

    def loss(b: np.ndarray) -> float:
        s = z(b)
        own = F.greatest(s, F.lit(0.0)) - s * y + F.log1p(F.exp(-F.abs(s)))
        return (rows.agg(F.sum(w * own)).first()[0] or 0.0) + 0.5 * b @ penalty @ b

    now = loss(beta)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-z(beta)))
        hessian, _ = _moments(rows, x, w * p * (1 - p), F.lit(0.0))
        slope = np.array(rows.agg(*[F.sum(w * (p - y) * col) for col in x]).first(), float) + penalty @ beta
        step, size = np.linalg.solve(hessian + penalty + 1e-12 * np.eye(len(x)), slope), 1.0
        while size > 1e-8 and (new := loss(beta - size * step)) > now:
            size /= 2
        if size <= 1e-8:
            break
        beta, done, now = beta - size * step, now - new < tolerance, new
        if done:
            break
    return beta


def score(features: Sequence[str], beta: Sequence[float], is_logistic: bool) -> Column:
    s = sum((F.col(f) * float(b) for f, b in zip(features, beta, strict=False)), F.lit(float(beta[-1])))
    return 1 / (1 + F.exp(-s)) if is_logistic else s


def thresholds(rows: DataFrame, column: str, margin: float = 1e-6) -> DataFrame:
    """Midpoints between neighbouring distinct scores, and one below and above all."""
    own = rows.select(column).filter(F.col(column).isNotNull()).distinct()
    ranked = checkpointed(with_rank(own, [F.col(column)], "_r"))
    after = ranked.select((F.col("_r") - 1).alias("_r"), F.col(column).alias("_next"))
    middle = ranked.join(after, "_r").select(((F.col(column) + F.col("_next")) / 2).alias("threshold"))
    ends = own.agg(F.min(column).alias("a"), F.max(column).alias("b")).filter("a is not null")
    return middle.union(ends.select(F.explode(F.array(F.col("a") - margin, F.col("b") + margin)).alias("threshold")))


def family_macro(rows: DataFrame, family: str, predicted: Column, truth: Column) -> DataFrame:
    """Macro precision, recall and F1 over families where they are defined."""
    per = rows.groupBy(family).agg(F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & truth).alias("fn"))
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per.agg(F.avg(d(tp, tp + fp)).alias("precision"), F.avg(d(tp, tp + fn)).alias("recall"), F.avg(d(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def select_model(models: DataFrame) -> DataFrame:
    """models (f1, precision, recall, l2, linear, threshold, ...): the best by f1, precision, recall, larger l2, linear
    first, smaller threshold."""
    order = [F.col(c).desc_nulls_last() for c in ("f1", "precision", "recall", "l2", "linear")]
    return models.orderBy(*order, F.col("threshold").asc()).limit(1)
