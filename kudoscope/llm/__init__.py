"""Operators for building training data from text at corpus scale.

Nothing else in the package imports this one.
"""
