"""quillspark: document-knowledge analytics on Spark DataFrames."""
