"""Operators that prepare training data: text, media, tokens, near duplicates, quality and privacy."""
