"""Column functions: labels, numbers, dates and places."""
