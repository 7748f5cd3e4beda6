"""Operators for building training corpora: quality, dedup, PII, mixing, packing and file formats.

Nothing outside this subpackage imports it, so it can be removed without touching the rest.
"""
