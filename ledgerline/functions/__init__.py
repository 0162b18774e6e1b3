"""Column-expression builders; none of them runs Python per row."""
