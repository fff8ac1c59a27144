"""Analytics operators; each takes and returns DataFrames."""
