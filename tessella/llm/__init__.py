"""Training-data operators: dedup, filters, scoring, formatting and tokenising of corpora."""
