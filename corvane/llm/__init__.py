"""Training-data operators: deduplication, filtering, scoring, mixing and token output."""
