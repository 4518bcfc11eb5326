"""Queries: facts, dimensions, KPI views and their registry."""
