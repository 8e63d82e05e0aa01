"""DataFrame operators; each takes DataFrames plus an explicit ``as_of``."""
