"""Vector functions: summaries, windows, conditionals and mathematics."""
