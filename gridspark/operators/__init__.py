"""Joins, windows, aggregates and selections over levels and samples."""
