"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it; ``registry`` lists the queries that
``__spark_entry__`` adds when the folder is present.
"""
