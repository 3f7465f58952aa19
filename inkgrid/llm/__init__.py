"""Operators for large training corpora.

Every operator takes DataFrames and returns a DataFrame.  Nothing outside this
subpackage imports it, so it can be removed as a whole.
"""
