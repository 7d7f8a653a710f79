"""Operators over DataFrames: split, features, models, votes, metrics, rank tests."""
