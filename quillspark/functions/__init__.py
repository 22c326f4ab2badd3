"""functions of the document-knowledge engine."""
