"""Operators for preparing large text collections for model training.

Nothing in the rest of the library imports this subpackage; it can be removed as a whole.
"""
