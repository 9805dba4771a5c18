"""Operators for preparing training text: tokens, secrets, quality, toxicity, near copies, packing, media."""
