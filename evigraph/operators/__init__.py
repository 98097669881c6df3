"""Relational operators over nodes, edges, chunks, postings and metrics."""
