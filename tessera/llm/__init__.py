"""Operators for preparing training text: scoring, deduplication, decontamination, mixing, token files."""
