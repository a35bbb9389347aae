"""Operators for preparing training text at corpus scale.

Self-contained: no other subpackage imports this one.
"""
