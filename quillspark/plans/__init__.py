"""plans of the document-knowledge engine."""
