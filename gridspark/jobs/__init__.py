"""Registered jobs over the driver's tables."""
