"""Column functions: plain expressions, no Python UDFs on the data path."""
