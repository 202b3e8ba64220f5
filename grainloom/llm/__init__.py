"""Training-data operators: mixing, scoring, extraction, deduplication and decontamination."""
