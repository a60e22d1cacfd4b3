"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` queries over the given tables. Nothing
outside this subpackage imports it.
"""
