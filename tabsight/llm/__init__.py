"""Operators for preparing training text at scale.

Self-contained: nothing else in the library imports this subpackage.
"""
