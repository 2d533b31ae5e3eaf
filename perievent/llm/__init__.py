"""Operators for preparing training text at scale: mixing, near-dedup, extraction, filtering, counting,
personal data, sharding, decontamination, language identification and language-model scoring."""
