"""Operators for preparing text corpora, beside the bibliographic engine.

Nothing outside this subpackage imports it. ``queries`` holds the registry.
"""
