"""Training-data pipeline operators: PII, decontamination, near-duplicates,
toxicity, token counts, HTML extraction, source mixing, URL filters, exact
top-k search and chat formatting. Nothing outside this package imports it."""
