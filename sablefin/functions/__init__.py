"""Column functions: text analysis, edit distances, geography, scores and vectors."""
