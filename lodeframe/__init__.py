"""lodeframe: a multimodal analytics engine that runs on Spark DataFrames."""

__version__ = "0.1.0"
