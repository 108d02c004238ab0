"""Tidemill streaming."""
