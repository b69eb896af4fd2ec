"""Operators for corpora and for very large columns that training-data pipelines need."""
