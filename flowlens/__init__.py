"""Network-flow analytics and intrusion detection on Spark DataFrames."""

__version__ = "0.1.0"
