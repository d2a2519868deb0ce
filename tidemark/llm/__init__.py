"""Operators for preparing text corpora: one module for each operator.

The rest of the library does not import this subpackage.
"""
