"""Operators of a training-data pipeline: text cleaning, packing, token files, scoring and search.

Nothing outside this package imports it. Each module holds one operator; ``queries`` registers them.
"""
