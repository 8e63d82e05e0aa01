"""Column-level functions; none of them touches a DataFrame."""
