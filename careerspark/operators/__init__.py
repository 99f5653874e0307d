"""DataFrame operators; every one takes and returns DataFrames and names its own keys."""
