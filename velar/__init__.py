"""velar: detection and removal of personal data on Spark DataFrames."""

__version__ = "0.1.0"
