"""Training-data operators: token files, deduplication, filtering, packing, fingerprints, language, extraction, decontamination."""
