"""Column functions. Built-in expressions wherever one exists."""
