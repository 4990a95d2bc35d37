"""The feature plan on tables with the reference's own column names."""

import datetime as dt

from bidlake.constants import CATEGORICAL_FEATURES, IMPRESSION_COLUMNS
from bidlake.plans.features import campaign_scores_from_source, feature_vectors_from

LOG_SCHEMA = ("AuctionType string, ehhn bigint, LogEntryTime timestamp, DeviceMake string, "
              "DeviceModel string, DeviceType string, Browser string, UserHourOfWeek int, "
              "SupplyVendor string, TemperatureInCelsius double, AdFormat string, "
              "Region string, Site string, Extra string")


def _log(spark, rows):
    return spark.createDataFrame(rows, LOG_SCHEMA)


def test_feature_vectors_on_reference_columns(spark):
    t = dt.datetime(2023, 1, 1)
    row = lambda hh, h, site, browser: (
        "first", hh, t + dt.timedelta(hours=h), "apple", "m1", "phone", browser, h, "sv",
        20.0, "banner", "OH", site, "x")
    y2022 = _log(spark, [row(1, 1, "a.com", "chrome"), row(2, 2, "b.com", "safari"),
                         row(3, 3, "c.com", "edge")])
    y2023 = _log(spark, [row(1, 5, "d.com", "chrome"), row(2, 1, "e.com", None)])
    # The newer yearly file lists its columns in another order.
    y2023 = y2023.select(*reversed(y2023.columns))
    ngr = campaign_scores_from_source(spark.createDataFrame(
        [(1, 0.9, "c1"), (2, 0.4, "c1")], "HSHD_CODE bigint, campaign_score double, camp string"))
    med = spark.createDataFrame([(1, 3.0), (2, 5.0), (3, 1.0)], "ehhn bigint, engagement double")

    out = feature_vectors_from([y2022, y2023], ngr, med)
    rows = {r.ehhn: r for r in out.collect()}
    # Household 3 has no score (not in the audience); 2's latest impression is from 2022.
    assert sorted(rows) == [1, 2]
    assert rows[1].LogEntryTime == t + dt.timedelta(hours=5)
    assert rows[2].LogEntryTime == t + dt.timedelta(hours=2)
    assert set(IMPRESSION_COLUMNS) <= set(out.columns) and "Extra" not in out.columns
    assert {"ngr_score", "engagement"} <= set(out.columns)
    for c in CATEGORICAL_FEATURES:
        assert dict(out.dtypes)[c] == "int"
    # First appearance by (LogEntryTime, ehhn): household 2 (hour 2) comes before 1 (hour 5).
    assert (rows[2].Site, rows[1].Site) == (1, 2)


def test_weekly_run_on_reference_columns(spark):
    """The whole run on tables with the reference's column names."""
    from pyspark.sql import functions as F

    from bidlake.plans.weekly import WeeklyInputs, run_weekly
    from bidlake.session import stage_path

    n = 400
    log = spark.range(n).select(
        F.col("id").alias("ImpressionId"), (F.col("id") % 60).alias("ehhn"),
        F.timestamp_seconds(F.lit(1_672_531_200) + F.col("id") * 60).alias("LogEntryTime"),
        *[F.concat(F.lit(c[:1]), (F.col("id") * (k + 3) % 5).cast("string")).alias(c)
          for k, c in enumerate(CATEGORICAL_FEATURES)],
        (F.col("id") % 168).cast("int").alias("UserHourOfWeek"),
        (F.col("id") % 30).cast("double").alias("TemperatureInCelsius"),
        (F.lit(0.002) + (F.col("id") % 7) * 0.0003).cast("string").alias("MediaCostInBucks"))
    delivered = spark.range(50).select(
        F.col("id").alias("HSHD_CODE"), (F.col("id") / 50.0).alias("campaign_score"),
        F.when(F.col("id") % 2 == 0, "IFO4").otherwise("IFO5").alias("cohort"))
    media = spark.range(120).select(
        (F.col("id") % 60).alias("ehhn"), F.col("id").alias("cycle"),
        (F.col("id") * 1.5).alias("engagement"))
    columns = [*IMPRESSION_COLUMNS, "ImpressionId", "MediaCostInBucks"]
    inputs = WeeklyInputs(
        logs=[log.where("ImpressionId < 200"), log.where("ImpressionId >= 200")],
        log_columns=columns, scores=campaign_scores_from_source(delivered), media=media,
        media_order=["cycle"], media_features=["engagement"], row_id="ImpressionId",
        cost="MediaCostInBucks", categoricals=CATEGORICAL_FEATURES,
        bid_features=["Site", "UserHourOfWeek", "ngr_score", "engagement"],
        conversion_features=["Site", "UserHourOfWeek", "engagement"],
        converted=F.col("Site") == "S1", cohorts=["IFO4", "IFO5", "IFO6"])
    paths = run_weekly(spark, inputs, stage_path(spark, "weekly-own"), regressors={"LM": None},
                       classifiers={"LR": None}, stamp="0101202401")
    share = {r.cohort: r for r in spark.read.parquet(paths["conversion_share"]).collect()}
    assert {c: r.households for c, r in share.items()} == {"IFO4": 25, "IFO5": 25, "IFO6": 0}
    assert spark.read.option("header", True).csv(paths["bids"]).count() == 50
    assert spark.read.parquet(paths["feature_vectors"]).count() == 100  # two snapshot rows each
    assert spark.read.parquet(paths["audience"]).count() == 50
