"""Operators for training-data pipelines of language models.

Nothing outside this subpackage imports it; it uses only ``pairloom.core`` and ``pairloom.functions``.
"""
