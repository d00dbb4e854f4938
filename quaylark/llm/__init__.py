"""Training-data operators: language ID, near-dedup, decontamination, secrets, tokens, media."""
