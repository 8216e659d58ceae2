"""Training-data operators for large corpora."""
