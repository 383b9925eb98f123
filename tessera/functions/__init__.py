"""functions of tessera."""
