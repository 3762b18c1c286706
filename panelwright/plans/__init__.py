"""Whole pipelines, and the panels that queries are run on."""
