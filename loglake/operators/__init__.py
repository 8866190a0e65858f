"""Storage and query operators."""
