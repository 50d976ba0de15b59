"""DataFrame operators: each takes DataFrame(s) and parameters and returns a DataFrame."""
