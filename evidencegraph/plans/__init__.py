"""Registered queries, and the pipeline over all stages."""
