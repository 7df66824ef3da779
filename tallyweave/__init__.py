"""Spark-native analytics over code-change corpora: tree, text and member diffs, corpus
pipelines and reports, and the operations of a training-data pipeline."""

__version__ = "0.1.0"
