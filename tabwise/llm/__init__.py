"""Operators of a training-data pipeline (ten numbered operators, see README).

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries
only when it can be imported.
"""
