"""Operators for preparing large text collections for model training.

Each module holds one operator; ``queries`` registers the thin driver queries.
Nothing outside this package imports it.
"""
