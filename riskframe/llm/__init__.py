"""Operators for building language-model training data, one module for each.

Nothing outside this folder imports it. ``catalog`` holds the registered queries and
``oracles`` their SQL.
"""
