"""Readers and writers: documents, word lists, and versioned index folders."""
