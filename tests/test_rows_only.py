"""Queries without a SQL twin (model output, streaming): they run on whole tables, return
rows, and have the expected columns and value ranges."""

import math

import pytest

import __spark_entry__ as entry
from bidlake import catalog

EXPECTED = {
    "train_leaderboard": {"family", "params", "metric", "score", "is_champion"},
    "bid_test_metrics": {"n", "n_missing", "r2", "mse"},
    "score_bids": {"ehhn", "week", "basebid"},
    "score_conversion": {"ehhn", "cohort", "week", "sales_conversion"},
    "conversion_report": {"cohort", "households", "converting", "share"},
    "live_pricing": {"ehhn", "event_id", "event_ts", "basebid", "reason"},
    "combined_predictions": {"ehhn", "cohort", "week", "basebid", "sales_conversion"},
    "conversion_test_metrics": {"cohort", "tp", "fp", "fn", "tn", "precision", "recall", "f1",
                                "balanced_accuracy", "auc", "average_precision"},
}


def test_every_rows_only_query_is_listed():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == set(EXPECTED)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_rows_only_query(spark, sf_small, name):
    df = entry.queries()[name](spark, sf_small)
    assert set(df.columns) == EXPECTED[name]
    rows = df.collect()
    assert rows
    if name == "train_leaderboard":
        assert sum(r.is_champion for r in rows) == 1
        champ = next(r for r in rows if r.is_champion)
        assert champ.score == max(r.score for r in rows if not math.isnan(r.score))
    if "sales_conversion" in EXPECTED[name]:
        assert all(0.0 <= r.sales_conversion <= 1.0 for r in rows)
    if name == "score_bids":
        assert len({r.ehhn for r in rows}) == len(rows)  # one bid per household
