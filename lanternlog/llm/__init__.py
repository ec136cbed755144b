"""Operators of a training-data pipeline. Nothing outside this package imports it.

``lanternlog.llm.queries`` registers them; ``corpus_pipeline.py`` at the repository top chains five.
"""
