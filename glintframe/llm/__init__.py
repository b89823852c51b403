"""Operators of a training-data pipeline: dedup, search, classifiers, extraction, decontamination, mixing, encoding.

One module for each operator; ``queries`` registers the thin ``opN_*`` queries over the given tables.
"""
