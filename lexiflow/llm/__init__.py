"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Each module has one operator; ``queries``
binds them to the benchmark tables.
"""
