"""Operators for preparing training text: quality, duplicates, counts, toxicity, mixing, language, personal data, scoring."""
