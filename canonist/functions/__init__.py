"""Column functions on text and dates."""
