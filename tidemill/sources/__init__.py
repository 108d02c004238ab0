"""Tidemill sources."""
