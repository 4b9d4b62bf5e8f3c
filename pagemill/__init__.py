"""Pagemill: a PySpark-native engine for paired samples, recognised text and result tables."""

__version__ = "0.1.0"
