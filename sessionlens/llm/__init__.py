"""Training-data operators: each takes a documents DataFrame and returns a DataFrame."""
