"""Column functions: names, labels, scores."""
