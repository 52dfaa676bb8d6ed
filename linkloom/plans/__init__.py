"""Whole pipelines, the stand-in inputs and the query catalogue."""
