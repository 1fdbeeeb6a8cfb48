"""Training-data operators: URL filters, dedup, mixing, decontamination, PII, output and quality."""
