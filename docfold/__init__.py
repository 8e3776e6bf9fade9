"""Batch and streaming jobs for a document-grounded chat service, for all users at once."""
