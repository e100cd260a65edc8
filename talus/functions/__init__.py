"""Column functions with the semantics of the logs' own runtime."""
