"""Training-data operators: deduplication, scoring, fingerprints, packing and decontamination."""
