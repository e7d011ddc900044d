"""Column functions: text, URLs, times and scores."""
