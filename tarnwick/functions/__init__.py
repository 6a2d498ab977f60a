"""Column functions for text, scores and identities."""
