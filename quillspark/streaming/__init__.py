"""streaming of the document-knowledge engine."""
