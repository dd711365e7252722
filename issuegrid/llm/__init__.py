"""Training-data operators: scoring, near-duplicates, decontamination, tokenizing, packing."""
