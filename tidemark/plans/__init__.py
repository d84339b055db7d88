"""Whole cycles, put together from the operators."""
