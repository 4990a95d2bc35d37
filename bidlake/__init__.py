"""bidlake: Spark-native household bid features, model training and batch scoring.

Every operator takes and returns Spark DataFrames; nothing is pulled to the driver
except scalars (counts behind broadcast decisions, bin ranges) and small model metadata.

Where things are:

* ``plans.features.feature_vectors_from`` - logs + campaign score + media snapshot ->
  encoded inference vectors (union, audience, latest per household, joins, encoding).
* ``plans.training.prepare_training`` / ``train_bid_model`` / ``train_conversion_model``
  - split, encode, exclude, label shift, MLlib model search with a champion.
* ``plans.scoring`` - batch bid and conversion scoring; ``plans.report`` - conversion
  share and score bins; ``plans.weekly.run_weekly`` - the whole weekly run.
* ``streaming.realtime`` - Structured Streaming live pricing.
* ``operators`` - the building blocks (relational, latest, encoding, split, sequence,
  broadcast, impute); ``functions.metrics`` - metrics as aggregates.
* ``catalog`` - registered queries and their DuckDB twins (``__spark_entry__.py``).
"""

__version__ = "0.1.0"
