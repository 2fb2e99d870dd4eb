"""quillon: structured preference search, evaluation and corpus tooling on Spark DataFrames."""

__version__ = "0.1.0"
