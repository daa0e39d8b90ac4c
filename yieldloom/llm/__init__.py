"""Training-data operators: deduplication, mixing, packing, language, quality, toxicity, secrets and
HTML extraction. Nothing else in the library imports this subpackage."""
