"""operators of the document-knowledge engine."""
