"""Training-data operators: mixing, quality, deduplication, search, extraction, tokenising, PII, WARC."""
