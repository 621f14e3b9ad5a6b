"""Training-data operators for text, pages and embeddings.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
registered queries and their SQL.
"""
