"""Queries of the operators over the driver's tables."""
