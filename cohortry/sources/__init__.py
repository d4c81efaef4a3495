"""Files, ids, labels and saved tables."""
