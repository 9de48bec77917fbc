"""Operators of a training-data pipeline: text fingerprints, filters, classifiers, tokens and de-duplication.

Nothing else in the library imports this subpackage.
"""
