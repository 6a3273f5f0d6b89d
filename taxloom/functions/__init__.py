"""Scalar functions as Columns, and the few pandas UDFs."""
