"""Column functions: text, dates, scores and vectors."""
