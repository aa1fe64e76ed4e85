"""Column functions on text, scores and geometry."""
