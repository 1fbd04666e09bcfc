"""Operators for preparing training data: near-duplicates, filters, tokens, packing, archives."""
