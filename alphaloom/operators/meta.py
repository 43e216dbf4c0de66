"""Secondary model that decides whether to act on a primary signal."""
from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.lineage import checkpointed


def targets(side: str = "side", fwd: str = "fwd") -> Column:
    """1 where following the side made money, 0 where not, NULL without a side."""
    won = F.coalesce(F.col(side) * F.col(fwd) > 0, F.lit(False))
    return F.when(F.col(side).isNotNull(), won.cast("double"))


def fit(df: DataFrame, features: list[str], *, side: str = "side", fwd: str = "fwd", l2: float = 1.0,
        estimator: Estimator | None = None, min_rows: int = 50):
    """Fit a classifier on complete rows.  The default penalises the squared
    weights (not the intercept) by l2 / 2 in total, as a share of the row count."""
    rows = df.select(side, fwd, *features).dropna().withColumn("label", targets(side, fwd))
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    n = rows.count()
    if n < min_rows:
        raise ValueError(f"need at least {min_rows} aligned observations")
    est = estimator or LogisticRegression(
        regParam=l2 / n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10
    )
    return est.fit(rows.select("features", "label"))


def predict(df: DataFrame, model, features: list[str], name: str = "probability") -> DataFrame:
    """Probability that the side is right; NULL where a feature is missing."""
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    filled = df.withColumn("_whole", whole).withColumns(
        {f"_f{i}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for i, f in enumerate(features)}
    )
    cols = [f"_f{i}" for i in range(len(features))]
    vec = VectorAssembler(inputCols=cols, outputCol="_vec").transform(filled)
    model = model.copy().setFeaturesCol("_vec").setProbabilityCol("_prob").setRawPredictionCol("_raw").setPredictionCol("_pred")
    out = model.transform(vec)
    p = F.when(F.col("_whole"), vector_to_array("_prob")[1])
    return out.withColumn(name, p).drop("_whole", "_vec", "_prob", "_raw", "_pred", *cols)


def newton_folds(
    rows: DataFrame, features: list[str], n_folds: int, *, fold: str = "fold", side: str = "side", fwd: str = "fwd",
    l2: float = 1.0, steps: int = 25, tol: float = 1e-12, min_rows: int = 50,
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (folds x 1 + features, intercept first) of one penalised logistic regression per
    fold, and the largest penalised gradient left in each.

    A Newton step is one grouped pass: per fold the gradient and the Gram sums of the
    training rows, a handful of numbers, come to the driver and the coefficients go back as
    literals.  Rows with a missing value teach nothing; a fold of fewer than `min_rows` raises.
    """
    k = 1 + len(features)
    known = rows.select(F.col(fold).alias("_fold"), side, fwd, *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    train = checkpointed(known.withColumn("_y", targets(side, fwd)).select("_fold", "_y", *features))
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    ridge = np.diag([0.0, *[l2] * len(features)])
    beta, left = np.zeros((n_folds, k)), np.full(n_folds, np.inf)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(steps):
        own = [F.element_at(F.array(*[F.lit(float(v)) for v in beta[:, j]]), (F.col("_fold") + 1).cast("int")) for j in range(k)]
        p = 1 / (1 + F.exp(-sum((b * v for b, v in zip(own[1:], x[1:], strict=True)), own[0])))
        held = train.withColumn("_p", p)
        miss, weight = F.col("_y") - F.col("_p"), F.col("_p") * (1 - F.col("_p"))
        sums = held.groupBy("_fold").agg(
            F.count("*").alias("n"), *[F.sum(miss * v).alias(f"g{j}") for j, v in enumerate(x)],
            *[F.sum(weight * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs],
        ).collect()
        if len(sums) < n_folds or min(r["n"] for r in sums) < min_rows:
            raise ValueError(f"need at least {min_rows} aligned observations in each fold")
        moved = 0.0
        for r in sums:
            f = r["_fold"]
            gradient = np.array([r[f"g{j}"] for j in range(k)]) - ridge @ beta[f]
            gram = np.zeros((k, k))
            for i, j in pairs:
                gram[i, j] = gram[j, i] = r[f"h{i}_{j}"]
            step = np.linalg.solve(gram + ridge, gradient)
            left[f] = np.abs(gradient).max()
            beta[f] += step
            moved = max(moved, np.abs(step).max())
        if moved < tol:
            break
    return beta, left


def predict_folds(rows: DataFrame, features: list[str], beta: np.ndarray, *, fold: str = "fold", name: str = "probability") -> DataFrame:
    """Probability by the coefficients of the row's fold; NULL where a feature is missing."""
    own = [F.element_at(F.array(*[F.lit(float(v)) for v in beta[:, j]]), (F.col(fold) + 1).cast("int")) for j in range(beta.shape[1])]
    z = own[0]
    for b, f in zip(own[1:], features, strict=True):
        z = z + b * F.col(f).cast("double")
    return rows.withColumn(name, 1 / (1 + F.exp(-z)))


def apply(side: str = "side", probability: str = "probability", threshold: float = 0.5) -> Column:
    """The side where the model says act, else zero."""
    act = F.coalesce(F.col(probability) >= threshold, F.lit(False))
    return F.coalesce(F.col(side), F.lit(0.0)) * act.cast("double")
