"""Operators for preparing text corpora: filters, fingerprints, near duplicates, counts and mixing."""
