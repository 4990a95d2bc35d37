"""A weighted ensemble of trained candidates.

With weights that sum to one, the ensemble's error on a row is the weighted sum of its members'
errors, so its squared error over all rows is w'Ew, where E holds the sums of products of errors
(k x k numbers for k members). One distributed aggregate over the validation rows gives E; every
weighting is then judged on the driver without touching a row again. (Products of errors, not of
predictions: near a perfect fit the latter would cancel to nothing.)

Weights come from greedy selection with replacement: starting from none, the member that lowers
the squared error of the plain average most is added, again and again; a member's weight is its
share of the additions, up to the best number of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import PREDICTION

#: Additions at most.
ADDITIONS = 25


@dataclass
class Ensemble:
    """Members with a positive weight; scores like a single model."""

    models: list[PipelineModel]
    weights: list[float]

    def transform(self, df: DataFrame, out_col: str = PREDICTION) -> DataFrame:
        """``df`` and the weighted prediction, in one pass over the rows."""
        columns = df.columns
        scored, names = with_predictions(df, self.models)
        total = F.lit(0.0)
        for name, weight in zip(names, self.weights, strict=True):
            total = total + F.lit(weight) * F.col(name)
        return scored.select(*[F.col(f"`{c}`") for c in columns], total.alias(out_col))

    def save(self, spark: SparkSession, path: str) -> str:
        """Members and weights under ``path``, which must not exist."""
        spark.createDataFrame([(k, w) for k, w in enumerate(self.weights)],
                              "member int, weight double").coalesce(1).write.json(f"{path}/weights")
        for k, model in enumerate(self.models):
            model.write().save(f"{path}/member-{k}")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        rows = spark.read.schema("member int, weight double").json(f"{path}/weights").orderBy(
            "member").collect()
        return cls([PipelineModel.load(f"{path}/member-{r['member']}") for r in rows],
                   [r["weight"] for r in rows])


def with_predictions(df: DataFrame, models: Sequence[PipelineModel]
                     ) -> tuple[DataFrame, list[str]]:
    """``df`` and a column for each model's prediction, whose names are returned."""
    out, names = df, []
    for k, model in enumerate(models):
        name = f"_prediction_{k}"
        scored = model.transform(out.select(*[F.col(f"`{c}`") for c in out.columns]))
        out = scored.select(*[F.col(f"`{c}`") for c in out.columns],
                            F.col(PREDICTION).alias(name))
        names.append(name)
    return out, names


def error_products(validation: DataFrame, models: Sequence[PipelineModel], label: str
                   ) -> tuple[list[list[float]], float, int]:
    """(E, sum of squares of the label around its mean, rows): one aggregate. Rows on which any
    value is missing don't count."""
    scored, names = with_predictions(validation, models)
    y = F.col(label).cast("double")
    rows = scored.select(y.alias("_y"), *names).na.drop()
    errors = [F.col(n) - F.col("_y") for n in names]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    got = rows.agg(*[F.sum(errors[i] * errors[j]).alias(f"_e{i}_{j}") for i, j in pairs],
                   (F.var_pop("_y") * F.count("_y")).alias("_sst"),
                   F.count("_y").alias("_n")).first()
    matrix = [[0.0] * len(names) for _ in names]
    for i, j in pairs:
        matrix[i][j] = matrix[j][i] = float(got[f"_e{i}_{j}"] or 0.0)
    return matrix, float(got["_sst"] or 0.0), int(got["_n"])


def squared_error(matrix: list[list[float]], weights: Sequence[float]) -> float:
    return sum(a * b * matrix[i][j] for i, a in enumerate(weights) for j, b in enumerate(weights))


def greedy_weights(matrix: list[list[float]], additions: int = ADDITIONS) -> list[float]:
    """Weights by greedy selection with replacement; ties go to the first member and to fewer
    additions."""
    counts = [0] * len(matrix)
    best: tuple[float, list[float]] | None = None
    for n in range(1, additions + 1):
        def after(k: int) -> float:
            return squared_error(matrix, [(c + (i == k)) / n for i, c in enumerate(counts)])

        counts[min(range(len(counts)), key=lambda k: (after(k), k))] += 1
        weights = [c / n for c in counts]
        error = squared_error(matrix, weights)
        if best is None or error < best[0]:
            best = (error, weights)
    return best[1]


def fit_ensemble(models: Sequence[PipelineModel], validation: DataFrame, label: str,
                 additions: int = ADDITIONS) -> tuple[Ensemble, DataFrame]:
    """The ensemble of ``models`` and its report: (member, weight, r2, ensemble_r2), the members'
    and the ensemble's R^2 on the validation rows (null if the label doesn't vary)."""
    if not models:
        raise ValueError("no member to choose from")
    matrix, sst, n = error_products(validation, models, label)
    if not n:
        raise ValueError("an ensemble needs validation rows")
    weights = greedy_weights(matrix, additions)

    def r2(error: float) -> float | None:
        return 1 - error / sst if sst > 0 else None

    whole = r2(squared_error(matrix, weights))
    report = validation.sparkSession.createDataFrame(
        [(k, float(w), r2(matrix[k][k]), whole) for k, w in enumerate(weights)],
        "member int, weight double, r2 double, ensemble_r2 double")
    kept = [k for k, w in enumerate(weights) if w > 0]
    return Ensemble([models[k] for k in kept], [weights[k] for k in kept]), report
