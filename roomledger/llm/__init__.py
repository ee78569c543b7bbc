"""Operators for preparing training data: documents in, documents or digests out."""
