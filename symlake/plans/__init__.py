"""Queries of the operators over bound tables."""
