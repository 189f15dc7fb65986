"""Relational, versioned and checking operators over DataFrames."""
