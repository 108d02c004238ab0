"""Tidemill: a Spark-native engine for analysing web crawls and web archives."""

__version__ = "0.1.0"
