"""Tidemill operators."""
