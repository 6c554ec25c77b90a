"""Tables in the engine's own schema, and the fetcher."""
