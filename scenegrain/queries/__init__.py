"""Registered queries: each a callable (spark, folder) with, where SQL can express it, the same in SQL."""
