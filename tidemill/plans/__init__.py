"""Tidemill plans: the catalogue of queries over tables."""
