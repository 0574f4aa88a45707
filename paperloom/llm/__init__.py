"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage; removing the folder
leaves the rest of the library intact.
"""
