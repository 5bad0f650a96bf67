"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes the columns
it needs by name and projects them away from the rest at once, so that further
columns of a table, whatever they are called, neither take part nor clash.
"""
