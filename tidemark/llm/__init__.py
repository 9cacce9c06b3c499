"""Operators for training-data pipelines: language, markup, duplicates, toxicity, packing, tokens, personal data, neighbours."""
