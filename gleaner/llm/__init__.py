"""Operators for building training data: tokens, mixing, deduplication, language, personal data and URLs."""
