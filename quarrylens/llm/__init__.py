"""Operators for preparing large text corpora: one module per operator, over DataFrames.

Nothing else in the library imports this subpackage.
"""
