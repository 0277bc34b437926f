"""The verbs."""
