"""SQL written apart from the DataFrame code, to check its results."""
