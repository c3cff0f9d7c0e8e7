"""Detections, joins and roll-ups over DataFrames."""
