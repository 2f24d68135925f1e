"""Set-at-a-time operators; each takes and returns DataFrames."""
