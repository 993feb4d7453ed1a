"""Operators of a training-data pipeline over tables of texts, urls and conversations.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
