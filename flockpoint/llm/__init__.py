"""Operators for building training data: language ID, packing, mixing, fingerprints, near-dedup,
quality, licences, line dedup, chat formatting and perplexity rules."""
