"""Training-data operators: media, sharding, personal data, quality, packing,
URL lists, secrets, near duplicates, toxicity and benchmark leakage.

Nothing outside this subpackage imports it.
"""
