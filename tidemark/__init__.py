"""Keyed three-way reconciliation and corpus preparation as Spark jobs."""
