"""Operators for preparing training corpora: dedup, filters, packing, formatting and token files."""
