"""Model metrics as distributed aggregates.

Every metric returns a DataFrame with one row per group (``group_cols``, possibly none)
so the same code scores one model, each cohort, or each split. Definitions (ours where
the libraries differ or warn):

* ``r2``  = 1 - SSE/SST, negative when worse than the mean; NULL when SST = 0.
* ``mse`` = mean squared error, lower is better.
* ``precision`` = TP/(TP+FP), ``recall`` = TP/(TP+FN), ``f1`` = 2TP/(2TP+FP+FN); 0 when
  the denominator is 0.
* ``balanced_accuracy`` = mean recall over the classes present in the labels.
* ``auc`` = P(score of a positive > score of a negative), ties count 1/2; NULL with one class.
* ``mae`` = mean absolute error; ``explained_variance`` = 1 - Var(y - p) / Var(y), NULL when
  Var(y) = 0.
* ``accuracy`` = share of right predictions; ``kappa`` = agreement beyond chance (Cohen), NULL
  when chance agreement is 1; ``log_loss`` with scores kept ``LOG_LOSS_EPS`` away from 0 and 1.
* ``median_absolute_error`` = the exact median of |y - p|; NULL without rows.
* ``average_precision`` = sum over distinct scores, descending, of
  (recall_n - recall_n-1) * precision_n; NULL without positives.

Ratios of counts are single divisions of exact integers. AUC's numerator is an exact
integer too. Nothing is rounded here: a bid price is a few thousandths, so its squared
error is far below any fixed number of decimals. Callers that compare engines round.

Regression rows whose label or prediction is missing can't be scored; they are counted in
``n_missing``, so a model that predicts nothing for hard rows shows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.selection import medians
from ..operators.sequence import running_totals
from ..sources.files import stage


def _i(c: str | Column) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("double")


def _safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


# ----------------------------------------------------------------------------- regression
def regression_metrics(df: DataFrame, label: str, prediction: str,
                       group_cols: Sequence[str] = ()) -> DataFrame:
    """X1 + X2: ``n``, ``n_missing``, ``r2``, ``mse`` per group, over rows with both values
    present (``n``); the others are counted in ``n_missing``."""
    both = _i(label).isNotNull() & _i(prediction).isNotNull()
    y, p = F.when(both, _i(label)), F.when(both, _i(prediction))
    agg = df.groupBy(*group_cols).agg(
        F.count(y).cast("bigint").alias("n"),
        F.count_if(~both).cast("bigint").alias("n_missing"),
        F.sum((y - p) * (y - p)).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
    )
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))
    return agg.select(*group_cols, "n", "n_missing", r2.alias("r2"),
                      F.try_divide("_sse", "n").alias("mse"))


def error_metrics(df: DataFrame, label: str, prediction: str,
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """``mae`` and ``explained_variance`` per group, over rows with both values present."""
    both = _i(label).isNotNull() & _i(prediction).isNotNull()
    y, p = F.when(both, _i(label)), F.when(both, _i(prediction))
    agg = df.groupBy(*group_cols).agg(
        F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y - p).alias("_ve"), F.var_pop(y).alias("_vy"))
    return agg.select(*group_cols, "mae", F.when(
        F.col("_vy") > 0, 1 - F.col("_ve") / F.col("_vy")).alias("explained_variance"))


def median_error(df: DataFrame, label: str, prediction: str, group_cols: Sequence[str] = ()
                 ) -> DataFrame:
    """``median_absolute_error`` per group, over rows with both values present: an exact median by
    selection (``operators/selection.py``), without a sort of the errors."""
    name = "median_absolute_error"
    errors = df.select(*group_cols, F.abs(_i(label) - _i(prediction)).alias(name))
    return medians(errors, name, group_cols, out_col=name)


# ------------------------------------------------------------------------- classification
def confusion_counts(df: DataFrame, label: str, predicted: Column,
                     group_cols: Sequence[str] = ()) -> DataFrame:
    y = F.col(label) == 1
    return df.groupBy(*group_cols).agg(
        F.count_if(y & predicted).cast("bigint").alias("tp"),
        F.count_if(~y & predicted).cast("bigint").alias("fp"),
        F.count_if(y & ~predicted).cast("bigint").alias("fn"),
        F.count_if(~y & ~predicted).cast("bigint").alias("tn"),
    )


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5,
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """X3 + X5-X7 for the prediction ``score > threshold`` (a NaN score is negative)."""
    s = F.col(score)
    predicted = F.coalesce((s > F.lit(threshold)) & ~F.isnan(s), F.lit(False))
    c = confusion_counts(df, label, predicted, group_cols)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    tpr = F.when(tp + fn > 0, tp.cast("double") / (tp + fn).cast("double"))
    tnr = F.when(tn + fp > 0, tn.cast("double") / (tn + fp).cast("double"))
    present = F.when(tpr.isNotNull(), 1).otherwise(0) + F.when(tnr.isNotNull(), 1).otherwise(0)
    bacc = F.when(present > 0, (F.coalesce(tpr, F.lit(0.0)) + F.coalesce(tnr, F.lit(0.0)))
                  / present.cast("double"))
    return c.select(
        *group_cols, "tp", "fp", "fn", "tn",
        _safe_ratio(tp, tp + fp).alias("precision"),
        _safe_ratio(tp, tp + fn).alias("recall"),
        _safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        bacc.alias("balanced_accuracy"),
    )


def agreement_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5,
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """``accuracy`` and ``kappa`` of the prediction ``score > threshold``."""
    s = F.col(score)
    predicted = F.coalesce((s > F.lit(threshold)) & ~F.isnan(s), F.lit(False))
    c = confusion_counts(df, label, predicted, group_cols)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    right = tp + tn
    # kappa = (n * right - chance) / (n^2 - chance), all whole numbers
    chance = (tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)
    return c.select(*group_cols, F.try_divide(right, n).alias("accuracy"), F.when(
        n * n > chance, (n * right - chance) / (n * n - chance)).alias("kappa"))


LOG_LOSS_EPS = 1e-15


def log_loss(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """``log_loss`` of a probability score, over rows with label and score (no NaN)."""
    p = F.least(F.greatest(_i(score), F.lit(LOG_LOSS_EPS)), F.lit(1 - LOG_LOSS_EPS))
    known = F.col(label).isNotNull() & _i(score).isNotNull() & ~F.isnan(_i(score))
    loss = -F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))
    return df.groupBy(*group_cols).agg(F.avg(F.when(known, loss)).alias("log_loss"))


def _score_counts(df: DataFrame, label: str, score: str, group_cols: Sequence[str]) -> DataFrame:
    # One row per distinct score: the rank metrics only need counts per score, and the
    # partial aggregate shrinks a billion rows to (at most) the distinct scores.
    return df.groupBy(*group_cols, score).agg(
        F.count_if(F.col(label) == 1).cast("bigint").alias("pos"),
        F.count_if(F.col(label) != 1).cast("bigint").alias("neg"),
    )


#: Slices of the score range at most; a slice's rows are ordered in one task.
SLICES = 256


def _sliced(counts: DataFrame, score: str, descending: bool,
            partitions: int | None) -> tuple[DataFrame, Column]:
    """Written counts, and for each row the slice of its score: quantile bounds taken once and
    used as literals, so all reads agree on them and one exchange orders the rows."""
    staged = stage(counts, "score-counts")
    conf = staged.sparkSession.conf
    n = min(SLICES, partitions or int(conf.get("spark.sql.shuffle.partitions")))
    value = F.col(score).cast("double")
    cuts = staged.agg(F.percentile_approx(
        F.when(~F.isnan(value), value), [k / n for k in range(1, n)] or [0.5], 1000)).first()[0]
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts or []))]).cast("array<double>")
    below = F.size(F.filter(bounds, lambda b: b < value))
    # a null score comes first in ascending order and last in descending order
    return staged, F.when(value.isNull(), 1 if descending else -1).otherwise(
        -below if descending else below)


def roc_auc(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = (),
            partitions: int | None = None) -> DataFrame:
    """Exact ROC AUC with ties as 1/2, per group; NULL when a class is missing."""
    counts, part = _sliced(_score_counts(df, label, score, group_cols), score, False, partitions)
    cum = running_totals(counts, [F.col(score).asc_nulls_first()], ["neg"], group_cols,
                         partitions, bucket=part)
    # For the positives at score s: negatives below s, plus half the negatives at s.
    # Doubled to stay integral: pos * (2 * neg_below + neg_at) = pos * (2 * neg_cum - neg).
    # decimal(38,0): pos * neg_cum can pass 2^63 on billions of rows.
    agg = cum.groupBy(*group_cols).agg(
        F.sum(F.col("pos").cast("decimal(38,0)")
              * (2 * F.col("neg_cum") - F.col("neg")).cast("decimal(38,0)")).alias("_num2"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
    )
    den = F.col("_p").cast("double") * F.col("_n").cast("double") * F.lit(2.0)
    auc = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_num2").cast("double") / den)
    return agg.select(*group_cols, auc.alias("auc"))


def average_precision(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = (),
                      partitions: int | None = None) -> DataFrame:
    """Average precision over distinct score thresholds, descending."""
    counts, part = _sliced(_score_counts(df, label, score, group_cols).withColumn(
        "cnt", F.col("pos") + F.col("neg")), score, True, partitions)
    cum = running_totals(counts, [F.col(score).desc_nulls_last()], ["pos", "cnt"], group_cols,
                         partitions, bucket=part)
    agg = cum.groupBy(*group_cols).agg(
        F.sum(F.col("pos").cast("double") * F.col("pos_cum").cast("double")
              / F.col("cnt_cum").cast("double")).alias("_s"),
        F.sum("pos").alias("_p"),
    )
    ap = F.when(F.col("_p") > 0, F.col("_s") / F.col("_p").cast("double"))
    return agg.select(*group_cols, ap.alias("average_precision"))


def pr_curve(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = (),
             partitions: int | None = None) -> DataFrame:
    """Precision and recall of "score at least this" for every distinct score: (groups..., score,
    tp, fp, precision, recall), as a distributed table. Recall is NULL without positives."""
    counts, part = _sliced(_score_counts(df, label, score, group_cols), score, True, partitions)
    cum = running_totals(counts, [F.col(score).desc_nulls_last()], ["pos", "neg"], group_cols,
                         partitions, bucket=part, with_total=True)
    tp, fp, all_ = F.col("pos_cum"), F.col("neg_cum"), F.col("pos_total")
    return cum.select(
        *group_cols, F.col(score).alias("score"), tp.alias("tp"), fp.alias("fp"),
        (tp.cast("double") / (tp + fp).cast("double")).alias("precision"),
        F.when(all_ > 0, tp.cast("double") / all_.cast("double")).alias("recall"))


# ------------------------------------------------------------------------------ registry
@dataclass(frozen=True)
class Metric:
    """A named metric, how to compute it, and whether larger is better."""
    name: str
    kind: str  # "regression" | "threshold" | "rank"
    higher_is_better: bool
    compute: Callable[..., DataFrame]
    column: str


METRICS: dict[str, Metric] = {
    "r2": Metric("r2", "regression", True, regression_metrics, "r2"),
    "mse": Metric("mse", "regression", False, regression_metrics, "mse"),
    "mae": Metric("mae", "regression", False, error_metrics, "mae"),
    "explained_variance": Metric("explained_variance", "regression", True, error_metrics,
                                 "explained_variance"),
    "median_absolute_error": Metric("median_absolute_error", "regression", False, median_error,
                                    "median_absolute_error"),
    "accuracy": Metric("accuracy", "threshold", True, agreement_metrics, "accuracy"),
    "kappa": Metric("kappa", "threshold", True, agreement_metrics, "kappa"),
    "log_loss": Metric("log_loss", "rank", False, log_loss, "log_loss"),
    "balanced_accuracy": Metric("balanced_accuracy", "threshold", True, threshold_metrics,
                                "balanced_accuracy"),
    "f1": Metric("f1", "threshold", True, threshold_metrics, "f1"),
    "precision": Metric("precision", "threshold", True, threshold_metrics, "precision"),
    "recall": Metric("recall", "threshold", True, threshold_metrics, "recall"),
    "auc": Metric("auc", "rank", True, roc_auc, "auc"),
    "average_precision": Metric("average_precision", "rank", True, average_precision,
                                "average_precision"),
}


def evaluate(df: DataFrame, metric: str, label: str, prediction: str,
             group_cols: Sequence[str] = ()) -> DataFrame:
    """Compute one registered metric: ``group_cols..., <metric>``."""
    m = METRICS[metric]
    out = m.compute(df, label, prediction, group_cols=group_cols)
    return out.select(*group_cols, m.column)
