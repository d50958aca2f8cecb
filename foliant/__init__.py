"""Foliant: document analytics and retrieval on Spark.

Text items become lines, chunks, typed elements and sections; chunks get hashed embeddings and sign
signatures; queries run a two-stage hybrid search and are answered with citations.
"""
