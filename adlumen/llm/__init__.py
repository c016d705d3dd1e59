"""Operators of a training-data pipeline: archives, filters, duplicates, packing and language-model scores."""
