"""Table access, runtime settings and the query registry."""
