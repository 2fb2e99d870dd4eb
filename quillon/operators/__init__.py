"""Operators on DataFrames: search, evaluation, audits, patterns, sampling, training features."""
