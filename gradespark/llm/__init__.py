"""Operators of a training-data pipeline: archives, scans, classifiers, counts, searches, mixing, packing, copies."""
