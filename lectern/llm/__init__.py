"""Operators for preparing text corpora: scans, filters, near copies, encoding, packing, sharding."""
