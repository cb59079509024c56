"""Relational, text, vector and graph operators over DataFrames."""
