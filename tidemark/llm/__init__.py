"""Operators for preparing large text and vector collections as training data.

Nothing outside this subpackage imports it.
"""
