"""The same reductions over streams."""
