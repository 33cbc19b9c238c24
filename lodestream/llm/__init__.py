"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage. ``registry`` holds the
queries and their SQL; every other module is one operator.
"""
