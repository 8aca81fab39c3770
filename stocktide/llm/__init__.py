"""Operators for language-model training data: filtering, near-duplicates, privacy, mixing, packing, sharding, chat, links."""
