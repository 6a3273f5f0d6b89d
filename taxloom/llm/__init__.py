"""Training-data operators: one module per operator, each usable on any DataFrame of the documented shape.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin registered queries and their SQL.
"""
