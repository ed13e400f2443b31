"""Spark-native scoring and evaluation of predicted binder-target pairs."""

__version__ = "0.1.0"
