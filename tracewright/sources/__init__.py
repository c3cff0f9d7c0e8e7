"""Readers: each gives a DataFrame of a documented schema."""
