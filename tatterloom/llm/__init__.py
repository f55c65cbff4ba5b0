"""Operators of a training-data pipeline: dedup, scoring, cleaning, tokenising, archiving."""
