"""Streaming.

The reference has no stream operators (no watermarks, windows, state or
late data).  The column functions of :mod:`labelflow.functions` and the
projection-only operators (``hash_split``, ``fraction_sample``, prompt
rendering, prediction cleaning) are stateless and apply unchanged to a
DataFrame from ``spark.readStream``; ``tests/test_streaming.py`` checks
that they give the same rows as on the batch DataFrame.
"""
