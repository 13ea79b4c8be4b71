"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it: the rest of the library works
without it.  ``registry`` lists its queries and their oracle SQL.
"""
