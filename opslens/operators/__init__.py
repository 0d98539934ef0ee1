"""DataFrame operators: each takes frames, column names and parameters and returns a frame."""
