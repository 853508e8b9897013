"""Operators of a training-data pipeline, one module per operator.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
(``llm.registry``) only if the folder is there.
"""
