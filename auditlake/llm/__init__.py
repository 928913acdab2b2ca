"""Operators of a training-data pipeline: language, contamination, mixing,
licences, near duplicates, sharding, quality, toxicity, personal data, tokens,
WARC archives, filter audits, importance resampling.

Nothing outside this subpackage imports it.
"""
