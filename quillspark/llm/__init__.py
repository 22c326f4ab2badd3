"""Training-data operators: dedup, similarity joins, tokenised output, packing,
scoring and web-archive assembly.  Nothing else in the library imports this
subpackage; ``queries`` holds the registered queries and their SQL."""
