"""Listings and change feeds as DataFrames."""
