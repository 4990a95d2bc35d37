import math

from hypothesis import given, settings
from hypothesis import strategies as st

from bidlake.functions.metrics import (
    average_precision,
    evaluate,
    regression_metrics,
    roc_auc,
    threshold_metrics,
)


def _frame(spark, ys, ss):
    return spark.createDataFrame(list(zip(ys, ss)), "y int, s double")


def brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y != 1]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(ys, ss):
    P = sum(1 for y in ys if y == 1)
    if P == 0:
        return None
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(ss), reverse=True):
        sel = [y for y, s in zip(ys, ss) if s >= t]
        tp = sum(1 for y in sel if y == 1)
        r = tp / P
        ap += (r - prev_r) * (tp / len(sel))
        prev_r = r
    return ap


def test_auc_all_tied_is_half(spark):
    df = _frame(spark, [0, 1, 0, 1], [0.3] * 4)
    assert roc_auc(df, "y", "s").first().auc == 0.5


def test_auc_single_class_is_null(spark):
    df = _frame(spark, [1, 1], [0.1, 0.2])
    assert roc_auc(df, "y", "s").first().auc is None


def test_threshold_metrics_no_positives(spark):
    df = _frame(spark, [0, 0], [0.1, 0.2])
    r = threshold_metrics(df, "y", "s").first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)
    assert r.balanced_accuracy == 1.0


def test_threshold_nan_is_not_positive(spark):
    df = _frame(spark, [1, 1], [float("nan"), 0.9])
    r = threshold_metrics(df, "y", "s").first()
    assert (r.tp, r.fn) == (1, 1)


def test_r2_negative_when_worse_than_mean(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 0.0), (3.0, 1.0)], "y double, p double")
    r = regression_metrics(df, "y", "p").first()
    assert r.r2 < 0 and r.n == 3
    assert abs(r.mse - (4 + 4 + 4) / 3) < 0.01


def test_registry_directions(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "y double, p double")
    assert evaluate(df, "r2", "y", "p").first().r2 == 1.0
    assert evaluate(df, "mse", "y", "p").first().mse == 0.0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.1, 0.2, 0.3, 0.5, 0.9])),
                min_size=1, max_size=30))
def test_rank_metrics_match_brute_force(spark, pairs):
    ys = [p[0] for p in pairs]
    ss = [p[1] for p in pairs]
    df = _frame(spark, ys, ss)
    got_auc = roc_auc(df, "y", "s", partitions=3).first().auc
    exp_auc = brute_auc(ys, ss)
    assert (got_auc is None and exp_auc is None) or math.isclose(got_auc, exp_auc, rel_tol=1e-12)
    got_ap = average_precision(df, "y", "s", partitions=3).first().average_precision
    exp_ap = brute_ap(ys, ss)
    assert (got_ap is None and exp_ap is None) or math.isclose(got_ap, exp_ap, abs_tol=1e-8)


def test_rank_metrics_many_distinct_scores_per_partition(spark):
    """More distinct scores per input partition than the range sampler's sample size:
    the partition ids used for the offsets must be the same rows' ids everywhere."""
    import random

    rnd = random.Random(5)
    data = [(rnd.choice(["a", "b", "c"]), int(rnd.random() < 0.3), round(rnd.random(), 4))
            for _ in range(6000)]
    df = spark.createDataFrame(data, "g string, y int, s double").repartition(7)
    got = {r.g: r.auc for r in roc_auc(df, "y", "s", ["g"], partitions=8).collect()}
    got_ap = {r.g: r.average_precision
              for r in average_precision(df, "y", "s", ["g"], partitions=8).collect()}
    for g in ("a", "b", "c"):
        ys = [y for gg, y, _ in data if gg == g]
        ss = [s for gg, _, s in data if gg == g]
        assert math.isclose(got[g], brute_auc(ys, ss), rel_tol=1e-12)
        assert math.isclose(got_ap[g], brute_ap(ys, ss), abs_tol=1e-8)


def test_regression_ignores_rows_missing_a_value(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (None, 2.0), (2.0, None)],
                               "y double, p double")
    r = regression_metrics(df, "y", "p").first()
    assert (r.n, r.r2, r.mse) == (2, 1.0, 0.0)


def test_mse_champion_at_bid_scale(spark):
    """Labels of a few thousandths: the MSE is tiny but not 0, and the better model wins."""
    from bidlake.models.train import train_regressors

    df = spark.range(200).selectExpr("id", "CAST(id % 17 AS DOUBLE) AS a",
                                     "0.002 + (id % 17) * 0.0001 AS y")
    for order in ([0.0, 1e6], [1e6, 0.0]):
        got = train_regressors(df, df, ["a"], "y", {"LM": {"regParam": order}}, metric="mse")
        assert got.best_params == {"regParam": 0.0}
        assert max(r.score for r in got.leaderboard.collect()) > 1e-8


def test_regression_metrics_full_precision_and_missing(spark):
    rows = [(0.002, 0.0021), (0.004, 0.0039), (0.003, None), (None, 0.001)]
    r = regression_metrics(spark.createDataFrame(rows, "y double, p double"), "y", "p").first()
    assert (r.n, r.n_missing) == (2, 2)
    assert math.isclose(r.mse, 1e-8, rel_tol=1e-9) and math.isclose(r.r2, 0.99, rel_tol=1e-9)
    none = regression_metrics(spark.createDataFrame([(None, 1.0)], "y double, p double"), "y", "p")
    assert none.first().asDict() == {"n": 0, "n_missing": 1, "r2": None, "mse": None}


def test_agreement_and_error_metrics(spark):
    df = _frame(spark, [1, 1, 1, 0, 0, 0], [0.9, 0.8, 0.2, 0.7, 0.1, 0.1])
    r = evaluate(df, "accuracy", "y", "s").first()
    k = evaluate(df, "kappa", "y", "s").first()
    assert math.isclose(r.accuracy, 4 / 6) and math.isclose(k.kappa, 1 / 3)
    want = -sum(math.log(x) for x in (0.9, 0.8, 0.2, 0.3, 0.9, 0.9)) / 6
    assert math.isclose(evaluate(df, "log_loss", "y", "s").first().log_loss, want)
    one = _frame(spark, [1, 0], [0.0, float("nan")])
    assert evaluate(one, "log_loss", "y", "s").first().log_loss < 40
    assert evaluate(_frame(spark, [1, 1], [0.9, 0.9]), "kappa", "y", "s").first().kappa is None
    reg = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (5.0, None)], "y double, p double")
    assert evaluate(reg, "mae", "y", "p").first().mae == 1.0
    assert evaluate(reg, "explained_variance", "y", "p").first().explained_variance == 1.0
