"""Operators on text corpora: quality, language models, fingerprints, scans, deduplication and mixing."""
