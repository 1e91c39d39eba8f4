"""Operators on indexes, hits, facets, vectors and vocabularies."""
