"""Operators for preparing training data: near and exact deduplication, quality, language,
toxicity and URL scoring, HTML extraction, decontamination, mixing and sharding.

Nothing else in the package imports this subpackage."""
