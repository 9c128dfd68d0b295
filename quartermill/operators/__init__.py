"""DataFrame operators: series, structures, selection, quality."""
