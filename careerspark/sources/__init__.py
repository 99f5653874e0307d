"""Reading and writing: delimited text, saved tables between jobs."""
