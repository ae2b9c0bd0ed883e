"""Operators for preparing model training data: filters, duplicates, labels, formats, packing."""
