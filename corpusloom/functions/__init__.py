"""Column functions: text, URLs, vectors and HTML."""
