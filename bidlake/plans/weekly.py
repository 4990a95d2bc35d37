"""One weekly run: features, training, bid and conversion scoring, report.

Everything is written under ``<out_root>/run=<stamp>/`` (run stamp: month, day, year,
hour). ``run_weekly`` takes the caller's own tables (``WeeklyInputs``); the command runs it on
the stand-ins. Outputs: the audience, the feature vectors (one row per household and
snapshot row, complete, encoded), the fitted encoding, the prepared training table's
leaderboard and test metrics, both models, the household vectors, the bids, the
conversion probabilities per cohort, and the report tables. All writes fail if the path
exists, so a repeated stamp never overwrites a previous run.

usage: python -m bidlake.plans.weekly --data DIR --out DIR [--week N] [--seed N]
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CONVERSION_COLUMN, KEY, SCORE, SOURCE_LABEL
from ..models.score import load_model
from ..models.train import save_model
from ..operators.latest import latest_per_key
from ..operators.relational import audience, rename_columns, union_logs
from ..session import build_session, release, run_stamp
from ..sources import standins
from ..sources.files import read_csv, stage, write_parquet
from . import features, scoring, training
from .report import conversion_share, score_bins

CONVERSION_SCHEMA = f"{KEY} bigint, {CONVERSION_COLUMN} double"


@dataclass
class WeeklyInputs:
    """The tables of one run and what their columns mean; all are keyed ``ehhn``."""

    logs: Sequence[DataFrame]           # yearly impression logs, aligned by name
    log_columns: Sequence[str]          # their columns that are used (row id and cost included)
    scores: DataFrame                   # ehhn, ngr_score, cohort; one row per household
    media: DataFrame                    # media-engagement snapshot, may repeat households
    media_order: Sequence[str]          # the latest snapshot row of a household is the greatest
    media_features: Sequence[str]       # snapshot columns the models use
    row_id: str                         # unique per impression; orders ties and the encoding
    cost: str                           # the label's source column
    categoricals: Sequence[str]
    bid_features: Sequence[str]
    conversion_features: Sequence[str]
    converted: Column                   # whether an impression converted
    cohorts: Sequence[str]              # cohorts that the report lists even if empty


def standin_inputs(spark: SparkSession, sf_dir: str) -> WeeklyInputs:
    """The driver's tables in the workflow's roles."""
    return WeeklyInputs(
        logs=standins.impression_logs(spark, sf_dir), log_columns=features.LOG_COLUMNS,
        scores=standins.campaign_scores(spark, sf_dir).select(KEY, SCORE, "cohort"),
        media=standins.media_engagement(spark, sf_dir), media_order=["o_orderdate", "o_orderkey"],
        media_features=training.SNAPSHOT_FEATURES, row_id="event_id", cost="cost",
        categoricals=training.BID_CATEGORICALS, bid_features=training.BID_FEATURES,
        conversion_features=training.CONVERSION_FEATURES,
        converted=F.col("event_type") == training.CONVERSION_EVENT, cohorts=standins.COHORTS)


def run_weekly(spark: SparkSession, inputs: WeeklyInputs, out_root: str, week: int = 1,
               seed: int = training.DEFAULT_SEED, regressors=None, classifiers=None,
               stamp: str | None = None, train_fraction: float | None = None,
               class_fractions: dict | None = None) -> dict[str, str]:
    root = f"{out_root.rstrip('/')}/run={stamp or run_stamp()}"
    paths: dict[str, str] = {}
    i = inputs

    def out(name: str) -> str:
        paths[name] = f"{root}/{name}"
        return paths[name]

    log = union_logs(list(i.logs), list(i.log_columns))
    snapshot = latest_per_key(i.media, KEY, list(i.media_order)).select(KEY, *i.media_features)

    # Feature extraction: the audience file and the vectors with every snapshot row kept.
    write_parquet(audience(log, i.scores), out("audience"))
    latest = stage(features.latest_in_audience(i.logs, i.scores, list(i.log_columns), i.row_id),
                   "latest-impressions")
    rows = features.complete_rows(latest, i.scores, i.media.select(
        *dict.fromkeys([KEY, *i.media_order, *i.media_features])))
    write_parquet(features.encode_rows(rows, i.categoricals, list(i.media_order)),
                  out("feature_vectors"))

    # Training: one prepared table, one encoding, both models.
    training_log = rename_columns(log, {i.row_id: training.ROW_ID, i.cost: SOURCE_LABEL})
    prepared, encoding = training.prepare_training(
        training.training_rows_from(training_log, i.scores, snapshot, i.converted),
        list(i.categoricals), training.ROW_ID, seed)
    encoding.save(out("encoding"))
    bid = training.train_bid_model(spark, "", regressors, seed, prepared, encoding,
                                   train_fraction, i.bid_features)
    write_parquet(bid.result.leaderboard, out("bid_leaderboard"))
    write_parquet(bid.test_metrics, out("bid_test_metrics"))
    save_model(bid.result.best, out("bid_model"))
    conv = training.train_conversion_model(prepared, classifiers, seed,
                                           class_fractions=class_fractions,
                                           feature_cols=i.conversion_features)
    write_parquet(conv.leaderboard, out("conversion_leaderboard"))
    write_parquet(training.conversion_test_metrics(conv.best, prepared),
                  out("conversion_test_metrics"))
    save_model(conv.best, out("conversion_model"))

    # Scoring: household vectors once, both models from their saved directories.
    # The written output doubles as the lineage cut both scorers read from.
    write_parquet(scoring.household_vectors_from(latest, i.scores, snapshot, encoding),
                  out("inference_vectors"))
    vectors = spark.read.parquet(paths["inference_vectors"])
    bids = scoring.score_bids(load_model(paths["bid_model"]), vectors, week)
    scoring.write_scores(bids, out("bids"))
    conversions = scoring.score_conversion(load_model(paths["conversion_model"]), vectors, week)
    scoring.write_scores(conversions, out("conversions"))

    # Report from the written conversion files (cohort and week come from the paths).
    written = read_csv(spark, paths["conversions"], CONVERSION_SCHEMA)
    written = written.withColumn("cohort", F.col("cohort").cast("string"))
    write_parquet(conversion_share(written, i.scores, i.cohorts), out("conversion_share"))
    write_parquet(score_bins(written, i.scores), out("score_bins"))
    return paths


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--data", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--week", type=int, default=1)
    ap.add_argument("--seed", type=int, default=training.DEFAULT_SEED)
    ap.add_argument("--master", default=None, help="only to override the submit command's")
    ap.add_argument("--train-fraction", type=float, default=None,
                    help="fit the bid model on this seeded share of the training split")
    args = ap.parse_args(argv)
    spark = build_session(args.master)
    paths = run_weekly(spark, standin_inputs(spark, args.data), args.out, args.week, args.seed,
                       train_fraction=args.train_fraction)
    release(spark)
    print(json.dumps(paths, indent=1))


if __name__ == "__main__":
    main()
