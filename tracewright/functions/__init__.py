"""Column functions: each takes columns and gives a column, and stays in the JVM."""
