"""Query registry over the engine's own operators."""
