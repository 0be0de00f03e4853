"""Streaming use.

The library owes no streaming operators of its own. The row-local functions (labels, negative
sampling, list filters, ranks, per-impression metrics) hold no state, so they apply to a
``readStream`` frame unchanged; ``tests/test_streaming.py`` runs them that way.
"""
