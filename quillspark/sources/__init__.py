"""sources of the document-knowledge engine."""
