"""Column-level building blocks (no DataFrame in, no shuffle)."""
