"""plans of tessera."""
