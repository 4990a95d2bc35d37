from bidlake.plans.report import conversion_share, score_bins


def test_share_nan_and_null_count_in_denominator(spark):
    scores = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)],
                                   "ehhn bigint, ngr_score double")
    preds = spark.createDataFrame(
        [(1, "A", 0.5), (2, "A", 0.51), (3, "A", float("nan")), (4, "A", None)],
        "ehhn bigint, cohort string, sales_conversion double")
    got = {r.cohort: r for r in conversion_share(preds, scores, ["A", "EMPTY"]).collect()}
    assert got["A"].households == 4 and got["A"].converting == 1 and got["A"].share == 0.25
    assert got["EMPTY"].households == 0 and got["EMPTY"].share is None


def test_score_bins_cover_all_rows(spark):
    scores = spark.createDataFrame([(i, float(i)) for i in range(50)], "ehhn bigint, ngr_score double")
    preds = spark.createDataFrame([(i, "A", i / 50.0) for i in range(50)],
                                  "ehhn bigint, cohort string, sales_conversion double")
    bins = score_bins(preds, scores, 10, 5).collect()
    assert sum(r.households for r in bins) == 50
    assert max(r.s_bin for r in bins) == 4 and max(r.p_bin for r in bins) == 9


def test_scored_cohorts_that_are_not_listed_stay(spark):
    preds = spark.createDataFrame([(1, "A", 0.9), (2, "B", 0.1)],
                                  "ehhn bigint, cohort string, sales_conversion double")
    scores = spark.createDataFrame([(1, 1.0), (2, 2.0)], "ehhn bigint, ngr_score double")
    got = {r.cohort: r.households for r in conversion_share(preds, scores, ["A"]).collect()}
    assert got == {"A": 1, "B": 1}
