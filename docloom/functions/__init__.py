"""Column functions: text, identifiers, dates, scores."""
