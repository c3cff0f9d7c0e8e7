"""Operators of a training-data pipeline: near-duplicates, scans, classifiers, mixing, packing, archives.

Nothing outside this subpackage imports it.
"""
