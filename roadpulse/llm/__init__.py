"""Training-data operators: scoring, extraction, de-duplication, mixing and layout of documents.

Nothing else in the library imports this subpackage.
"""
