"""From SQL text to a statement, and from a statement to DataFrame expressions."""
