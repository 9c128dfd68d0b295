"""Column functions: periods, numbers, text, HTML tables and extraction."""
