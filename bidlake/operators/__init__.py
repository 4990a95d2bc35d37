"""Relational, encoding, splitting and sequencing operators over DataFrames."""
