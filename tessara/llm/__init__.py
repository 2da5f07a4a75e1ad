"""Operators for building language-model training data.

Every module holds one operator with a general interface; ``queries`` holds
the registered queries, which apply the operators with production parameters
to whole tables.
"""
