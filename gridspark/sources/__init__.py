"""Readers, writers and the levels that the driver's tables stand for."""
